"""Scoring parsed rows against a golden list."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import near


_GOLDEN = ["resident", "nonresident", "currency"]
_PARSED = ["row_id", "resident", "nonresident", "currency", "tiers", "needs_review"]


def compare(golden: DataFrame, parsed: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """A verdict per golden row: ok, wrong_resident, wrong_foreign, wrong_currency or missing, and whether the parsed row
    was to be reviewed. golden and parsed: key, code_key, resident, nonresident, currency (parsed: tiers, needs_review,
    row_id; golden: golden_id). By key, else by code; of several, the one of the same code, then of the nearest price."""
    asked = golden.select("key", "code_key", "golden_id", F.struct(*_GOLDEN).alias("golden"))
    found = parsed.select("key", "code_key", F.struct(*_PARSED).alias("parsed"))
    # Without a key a row stands alone.
    lone = F.when(F.col("key").isNull(), F.xxhash64("golden_id"))
    keyed = judged(asked.unionByName(found.where("key is not null"), allowMissingColumns=True).withColumn("lone", lone), ["key", "lone"], "code_key", tolerance, ["lone"])
    open_ = keyed.where("verdict = 'missing' and coalesce(code_key, '') <> ''")
    settled = keyed.where("verdict <> 'missing' or coalesce(code_key, '') = ''")
    coded = open_.select("code_key", "golden_id", "golden").unionByName(found.where("code_key is not null").select("code_key", "parsed"), allowMissingColumns=True)
    return settled.select("golden_id", "verdict", "flagged").unionByName(judged(coded, ["code_key"], None, tolerance).select("golden_id", "verdict", "flagged"))


def judged(rows: DataFrame, by: list[str], code: str | None, tolerance: float = 0.5, nullable: Sequence[str] = ()) -> DataFrame:
    """The golden ones of the rows with ``verdict`` and ``flagged``, by the parsed ones of the same ``by`` (none where one
    is null, but for ``nullable``): of the same code if there are any, of the nearest price, of the least row_id. A row has
    golden: struct(resident, nonresident, currency), or parsed: struct(row_id, resident, nonresident, currency, tiers,
    needs_review). Groups are walked in the order of prices, so that the work grows with rows, not with pairs, and rows
    that are dealt by some of ``by`` stay where they are."""
    known = [F.col(c).isNotNull() for c in by if c not in nullable]
    placed = rows.withColumns({"__price": F.coalesce("golden.resident", "parsed.resident"), "__asked": F.col("golden").isNotNull()})
    if code:
        placed = _settled(placed, [*by, code], all_of([*known, F.col(code).isNotNull()]), tolerance, None)
    placed = _settled(placed, by, all_of(known), tolerance, F.col("__found") if code else None)
    found = F.col("__found")
    return placed.where("__asked").withColumns({"verdict": F.coalesce(found["verdict"], F.lit("missing")), "flagged": F.coalesce(found["flagged"], F.lit(False))}).drop("__price", "__asked", "__found", "parsed")


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _settled(rows: DataFrame, by: list[str], known: Column, tolerance: float, before: Column | None) -> DataFrame:
    """Adds ``__found``, what :func:`_found` says of the nearest parsed row; what was found ``before`` stays."""
    # One order for all: rows of one price share its parsed row of the least id; then the last before and the next behind.
    group = Window.partitionBy(*by)
    priced = group.orderBy("__price")
    columns = ", ".join(f"`{c}`" for c in by)
    rows = rows.withColumn("__same", F.min_by("parsed", "parsed.row_id").over(priced.rangeBetween(Window.currentRow, Window.currentRow)))
    rows = rows.withColumns(
        {
            "__below": F.last("__same", ignorenulls=True).over(priced.rowsBetween(Window.unboundedPreceding, 0)),
            "__above": F.expr(f"lead(__same) IGNORE NULLS OVER (PARTITION BY {columns} ORDER BY __price)"),
        }
    ).withColumn("__least", F.min_by("parsed", "parsed.row_id").over(group))
    below, above = F.col("__below"), F.col("__above")
    far = lambda p: F.coalesce(F.abs(F.col("__price") - p["resident"]), F.lit(1e18))
    lower = above.isNull() | (far(below) < far(above)) | ((far(below) == far(above)) & (below["row_id"] < above["row_id"]))
    hit = F.when(F.col("__price").isNull(), F.col("__least")).when(below.isNotNull() & lower, below).otherwise(above)
    rows = rows.withColumn("__hit", F.when(F.col("__asked") & known, hit))
    found = _found(F.col("golden"), F.col("__hit"), tolerance)
    return rows.withColumn("__found", found if before is None else F.coalesce(before, found)).drop("__same", "__below", "__above", "__least", "__hit")


def _found(golden: Column, p: Column, tolerance: float) -> Column:
    """struct(verdict, flagged) of a golden row and the parsed one it met; null if none."""
    foreign = F.array_compact(F.array_append(F.coalesce(F.map_values(p["tiers"]), F.array().cast("array<double>")), p["nonresident"]))
    foreign_ok = golden["nonresident"].isNull() | F.exists(foreign, lambda x: F.abs(x - golden["nonresident"]) <= tolerance)
    verdict = (
        F.when(golden["currency"] != p["currency"], "wrong_currency")
        .when(~near(golden["resident"], p["resident"], tolerance), "wrong_resident")
        .when(~foreign_ok, "wrong_foreign")
        .otherwise("ok")
    )
    return F.when(p.isNotNull(), F.struct(verdict.alias("verdict"), F.coalesce(p["needs_review"], F.lit(False)).alias("flagged")))


def nearest(rows: DataFrame, by: list[str], price: str, parsed: str, order: list[str], what: str) -> DataFrame:
    """Adds ``near_<price>`` and ``near_<what>`` of the parsed row of the nearest price in hundredths, of the least
    ``order``, to the rows that are not parsed; null if there is none. All are longs."""
    # Parsed rows of a price come first, the least of them before all: it stands for the price.
    walk = Window.partitionBy(*by).orderBy(price, F.desc(parsed), *order)
    columns = [price, what, *order]
    first = F.col(parsed) & ~F.col(price).eqNullSafe(F.col("__last"))
    rows = rows.withColumn("__last", F.lag(price).over(walk)).withColumns({f"__{c}": F.when(first, F.col(c)) for c in columns})
    behind = f"PARTITION BY {', '.join(by)} ORDER BY {price}, {parsed} DESC, {', '.join(order)}"
    rows = rows.withColumns({f"__below_{c}": F.last(f"__{c}", ignorenulls=True).over(walk.rowsBetween(Window.unboundedPreceding, 0)) for c in columns} | {f"__above_{c}": F.expr(f"lead(__{c}) IGNORE NULLS OVER ({behind})") for c in columns})
    own, below, above = (F.col(c) / 100.0 for c in (price, f"__below_{price}", f"__above_{price}"))
    earlier = F.struct(*[f"__below_{c}" for c in order]) < F.struct(*[f"__above_{c}" for c in order])
    lower = above.isNull() | (own - below < above - own) | ((own - below == above - own) & earlier)
    rows = rows.withColumn("__lower", below.isNotNull() & lower)
    near = {f"near_{c}": F.when(~F.col(parsed), F.when(F.col("__lower"), F.col(f"__below_{c}")).otherwise(F.col(f"__above_{c}"))) for c in (price, what)}
    return rows.withColumns(near).drop("__last", "__lower", *[f"__{k}{c}" for c in columns for k in ("", "below_", "above_")])


def accuracy(verdicts: DataFrame, least: float = 0.95) -> DataFrame:
    """One row: total, correct, accuracy, effective (wrong but flagged counts), silent errors, and the gate."""
    ok, found = F.col("verdict") == "ok", F.col("verdict") != "missing"
    n = verdicts.agg(F.count("*").alias("total"), F.count_if(ok).alias("correct"), F.count_if(~ok & found & F.col("flagged")).alias("flagged_wrong"), F.count_if(~ok & found & ~F.col("flagged")).alias("silent"))
    share = lambda x: F.when(F.col("total") > 0, x / F.col("total")).otherwise(0.0)
    effective = share(F.col("correct") + F.col("flagged_wrong"))
    return n.withColumn("accuracy", share(F.col("correct"))).withColumn("effective", effective).withColumn("passed", (effective >= least) & (F.col("silent") == 0))


def align(golden: list[tuple[str, float | None]], parsed: list[tuple[str, list[float]]], tolerance: float = 0.5) -> list[int | None]:
    """For each golden (key, price) of one document the parsed row (key, prices) it takes, or None: one row after the
    other, the first free row of its name, else the first free one with a price within the tolerance."""
    free = dict.fromkeys(range(len(parsed)))
    taken: list[int | None] = []
    for key, price in golden:
        hit = next((j for j in free if parsed[j][0] == key), None)
        if hit is None and price is not None:
            hit = next((j for j in free if any(abs(p - price) <= tolerance for p in parsed[j][1])), None)
        free.pop(hit, None)
        taken.append(hit)
    return taken
