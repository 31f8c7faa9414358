"""Tokens, packing and sharding: round trips and plain versions."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pricelake.llm import bpe, packing, sharding

tokenizers = pytest.importorskip("public_tokenizers")


def test_bpe_equals_the_library(docs):
    import base64

    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.decode(bpe.encode(docs.drop("size"), path, tokenizers.PATTERN), path, tokenizers.PATTERN).collect()
    texts = {(r["doc_id"], r["key"]): r["text"] for r in docs.collect()}
    for r in rows:
        text = texts[(r["doc_id"], r["key"])] or ""
        assert list(r["ids"]) == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    rnd = random.Random(1)
    own = bpe.Encoder(ranks, tokenizers.PATTERN)
    for n in (1, 2, 5, 33, 70, 1100):
        text = "".join(rnd.choice("abé日🙂 \n'sdl1!") for _ in range(n)) + "ab" * n
        assert own.encode(text).tolist() == library.encode_ordinary(text)
    with pytest.raises(ValueError, match="already"):
        bpe.encode(docs, path, tokenizers.PATTERN, ids_col="size")


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(3)
    for _ in range(60):
        capacity = rnd.randint(1, 40)
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 120))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        rooms, seen = {}, {}
        for length, low, high, first, at, per_bin in packing.plan(histogram, capacity):
            for rank in range(low, high):
                k, offset = first + (rank - low) // per_bin, at + (rank - low) % per_bin * length
                assert offset == rooms.get(k, 0)
                rooms[k] = offset + length
                seen[length] = seen.get(length, 0) + 1
        assert seen == histogram and sorted(capacity - u for u in rooms.values()) == plain_best_fit(lengths, capacity)


def test_pack(docs):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    pieces = packing.tokenize_pieces(docs, path, 1, 64, with_ids=True)
    rows = packing.pack(pieces, 64).collect()
    library = Tokenizer.from_file(path)
    expected = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        expected += [(r["doc_id"], k, s, own) for k, s in enumerate(range(0, len(ids), 64)) if (own := ids[s : s + 64])]
    assert sorted(((r["doc_id"], r["piece"], r["start"], list(r["ids"])) for r in rows), key=str) == sorted(expected, key=str)
    assert all(r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"])) for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64


def test_plain_words_equal_the_library():
    words = packing._Words(tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(5)
    for _ in range(3000):
        for w in "".join(rnd.choice("abcXYZéÉßöÿ.,!'|<>-_0129 ¼½ñ§À$%*()`~^&@:;") for _ in range(rnd.randint(1, 9))).split():
            ids = words.tokenizer.encode(w, add_special_tokens=False).ids
            assert words[w.encode()] == struct.pack(f"<{len(ids)}I", *ids)


def test_empty(none):
    assert packing.pack(packing.tokenize_pieces(none, tokenizers.path("word_bpe_49k.json"))).count() == 0
    assert sharding.shard(none).count() == 0
    assert bpe.encode(none, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN).count() == 0


def test_shards_are_even_and_follow_the_ring(docs):
    rows = sharding.shard(docs, shards=4, points=8).collect()
    assert len(rows) == docs.count() and all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1 and len(by_shard) == 4
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    texts = {(i, (t or "")) for i, t in ((r["doc_id"], r["text"]) for r in docs.collect())}
    sizes = sorted(((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts), key=str)
    assert sorted({(r["doc_id"], r["size"], r["text_crc32"]) for r in rows}, key=str) == sizes


def test_walk_equals_one_key_at_a_time():
    rnd = random.Random(7)
    for _ in range(100):
        arcs, shards = rnd.randint(1, 12), rnd.randint(1, 4)
        owners = [rnd.randrange(shards) for _ in range(arcs - 1)] + [0]
        owners = [*owners, *range(shards)]
        counts = [rnd.randint(0, 9) for _ in owners]
        share, more = divmod(sum(counts), shards)
        bounds = [share + (s < more) for s in range(shards)]
        placed, room, away = {}, list(bounds), []
        for arc, n in enumerate(counts):
            for rank in range(n):
                if room[owners[arc]]:
                    placed[arc, rank] = owners[arc]
                    room[owners[arc]] -= 1
                else:
                    away.append((arc, rank))
        for arc, rank in away:
            at = arc
            while not room[owners[at]]:
                at = (at + 1) % len(owners)
            placed[arc, rank] = owners[at]
            room[owners[at]] -= 1
        got = {(arc, r): s for arc, low, high, s, _ in sharding.walk(counts, owners, bounds) for r in range(low, high)}
        assert got == placed


def test_ring_moves_little(spark):
    """A few more keys move few of those that were there."""
    rows = [(i, f"t{i}") for i in range(2000)]
    before = {r["doc_id"]: r["shard"] for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    after = {r["doc_id"]: r["shard"] for r in sharding.shard(spark.createDataFrame([*rows, *((i, "new") for i in range(5000, 5016))], "doc_id long, text string")).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.1 * len(before)
    assert F is not None
