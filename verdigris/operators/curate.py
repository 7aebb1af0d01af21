"""Sample curation: quality filters, orders, and round-robin over buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS
from .ordinals import with_ordinal


def readable(d: DataFrame) -> DataFrame:
    """Read speech: a path and a sentence of 25 to 180 characters."""
    return d.where((F.coalesce("path", F.lit("")) != "") & F.length("sentence").between(25, 180))


def spontaneous(d: DataFrame) -> DataFrame:
    """Not voted down, over 10 characters, 3 to 30 seconds."""
    return d.where((F.col("votes") >= 0) & (F.length("transcription") > 10) & F.col("duration_ms").between(3000, 30000))


def n_tokens(text: Column) -> Column:
    """Parts between white space, empty edges counted."""
    return F.size(F.split(text, f"[{WS}]+"))


def long_form(d: DataFrame) -> DataFrame:
    """30 to 90 seconds, 20 to 140 tokens, a known speaker."""
    return d.where(F.col("duration_seconds").between(30, 90) & n_tokens(F.col("ground_truth")).between(20, 140) & (F.coalesce("speaker_id", F.lit("")) != ""))


def by_locale(c: str) -> Column:
    return F.collate(F.col(c), "UNICODE")


def read_order() -> list[Column]:
    return [F.desc("up_votes"), F.asc("down_votes"), F.length("sentence").asc(), by_locale("path").asc()]


def spontaneous_order() -> list[Column]:
    return [F.desc("votes"), F.asc("duration_ms"), by_locale("audio_file").asc()]


def long_form_order() -> list[Column]:
    return [F.asc("split"), F.asc("duration_seconds"), F.asc("id")]


def sample_round_robin(d: DataFrame, bucket: Column, order: list[Column], target: int) -> DataFrame:
    """The first of each bucket in order of bucket, then the second of each, up to ``target``."""
    n = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    ranked = d.withColumn("__bucket", bucket).withColumn("pick", n.cast("long")).where(F.col("pick") <= target)
    return ranked.orderBy("pick", "__bucket").limit(target).withColumnRenamed("__bucket", "bucket")


def walk(sizes: list[int], target: int, step_first: bool = False) -> list[tuple[int, int]]:
    """(bucket, its how-manieth row) of each pick. The cursor counts on over the buckets that are left; it stays when a bucket
    runs dry, or with ``step_first`` goes on all the same, and is then taken modulo the buckets left."""
    left, used, at, picks = list(range(len(sizes))), [0] * len(sizes), 0, []
    while left and len(picks) < target:
        b = left[at % len(left)]
        used[b] += 1
        picks.append((b, used[b]))
        dry = used[b] >= sizes[b]
        at += step_first or not dry
        if dry:
            left.remove(b)
            at = at % len(left) if left else 0
    return picks


def sample_round_robin_exact(d: DataFrame, bucket: Column, order: list[Column], target: int, first_seen: bool = False, step_first: bool = False) -> DataFrame:
    """The same with one cursor, as ``walk`` moves it, which skews later turns. Buckets go by name, or by their best row with
    ``first_seen``. No more than ``target`` buckets can be reached, so the walk over their sizes is bounded by it."""
    ranked = d.withColumn("__bucket", bucket)
    ranked = ranked.withColumn("__n", F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))).where(F.col("__n") <= target)
    if first_seen:
        best = ranked.where("__n = 1").orderBy(*order).limit(target).select("__bucket").collect()
        names = [r[0] for r in best]
    else:
        names = [r[0] for r in ranked.select("__bucket").distinct().orderBy("__bucket").limit(target).collect()]
    of = ranked.where(F.col("__bucket").isin(names)).groupBy("__bucket").agg(F.max("__n").alias("n")).collect()
    sizes = {r[0]: r["n"] for r in of}
    picks = walk([sizes.get(x, 0) for x in names if x in sizes], target, step_first)
    names = [x for x in names if x in sizes]
    kind = ranked.schema["__bucket"].dataType.simpleString()
    table = d.sparkSession.createDataFrame([(names[b], n, i) for i, (b, n) in enumerate(picks, 1)], f"__b {kind}, __k int, pick long")
    hit = (F.col("__bucket") == F.col("__b")) & (F.col("__n") == F.col("__k"))
    return ranked.join(F.broadcast(table), hit).select(*[F.col(f"`{c}`") for c in d.columns], "pick")


def top_by_id(d: DataFrame, id_col: str, n: int = 25) -> DataFrame:
    return d.orderBy(id_col).limit(n)


def dedupe_by_id(d: DataFrame, id_col: str, order: str) -> DataFrame:
    """The first row of each id by ``order``."""
    row = F.struct(*[c for c in d.columns if c != id_col])
    return d.groupBy(id_col).agg(F.min_by(row, F.col(order)).alias("r")).select(id_col, "r.*")


def numbered(d: DataFrame, prefix: str, order: list[Column]) -> DataFrame:
    """Test ids with a zero-padded index in the selection, set before anything else is filtered."""
    n = with_ordinal(d, order, "__n")
    return n.withColumn("test_id", F.format_string(f"{prefix}-%02d", F.col("__n"))).drop("__n")


def candidates(d: DataFrame, split_order: tuple[str, ...], target: int = 80) -> DataFrame:
    """The first ``target`` usable rows of a corpus by split, then by place; of equal ids the first. ``d``: id, split, ord, ..."""
    place = F.array_position(F.array(*map(F.lit, split_order)), F.col("split"))
    one = dedupe_by_id(d.withColumn("split_ord", place).withColumn("place", F.struct("split_ord", "ord")), "id", "place")
    return long_form(one.where("split_ord > 0")).orderBy("split_ord", "ord").limit(target).drop("place", "split_ord")


def of_language(suites: DataFrame, language: str | None) -> DataFrame:
    return suites if language is None else suites.where(F.col("language") == language)


def total_tests(suites: DataFrame) -> DataFrame:
    """Tests in nested suites."""
    return suites.agg(F.coalesce(F.sum(F.size("tests")), F.lit(0)).cast("long").alias("total_tests"))
