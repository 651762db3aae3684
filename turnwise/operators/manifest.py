"""Manifests: union, dedup, validation, statistics, batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.stored import stored

#: Functions of blocks composed at once, and the type of a way out of a block.
FAN, WAY = 64, "struct<p: int, r: boolean, c: bigint>"


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order; null keys are one key."""
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(k).orderBy(*order))).filter("_r = 1").drop("_r")


def any_path(*names: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in names))


def in_range(rows: DataFrame, column: str, low: float = 1, high: float = 600) -> DataFrame:
    return rows.filter(F.col(column).between(low, high))


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def validate_entries(rows: DataFrame, files: DataFrame) -> DataFrame:
    """First error of each entry: fields, audio, alignment; null if valid."""
    have = files.select("path").distinct()
    a = have.withColumnRenamed("path", "audio_path").withColumn("_a", F.lit(True))
    b = have.withColumnRenamed("path", "alignment_path").withColumn("_b", F.lit(True))
    j = rows.join(a, "audio_path", "left").join(b, "alignment_path", "left")
    error = F.when(F.col("id").isNull() | F.col("audio_path").isNull() | F.col("duration").isNull(), "missing_field").when(F.col("_a").isNull(), "missing_audio").when(F.col("_b").isNull(), "missing_alignment")
    return j.withColumn("error", error).drop("_a", "_b")


def alignment_error(json: str) -> Column:
    """First format error of an alignment document, null if it is sound.

    ``{"alignments": [[word, [start, end], speaker], ...]}``; empty lists pass.
    """
    v = F.try_parse_json(F.col(json))
    items = F.try_variant_get(v, "$.alignments", "array<variant>")
    first = items[0]
    pair = F.try_variant_get(first, "$[1]", "array<double>")
    return (
        F.when(v.isNull(), "no_json")
        .when(F.try_variant_get(v, "$.alignments", "variant").isNull(), "no_key")
        .when(items.isNull(), "no_list")
        .when(F.size(items) == 0, F.lit(None))
        .when(F.coalesce(F.size(F.try_variant_get(first, "$", "array<variant>")), F.lit(0)) != 3, "no_triple")
        .when(F.schema_of_variant(F.try_variant_get(first, "$[0]", "variant")) != "STRING", "word")
        .when(pair.isNull() | (F.size(pair) != 2), "times")
        .when(F.schema_of_variant(F.try_variant_get(first, "$[2]", "variant")) != "STRING", "speaker")
    )


def merge_statistics(flagged: DataFrame, hours: str = "duration") -> DataFrame:
    """Counts of a merge over rows flagged ``duplicate`` and ``error``."""
    ok = ~F.col("duplicate") & F.col("error").isNull()
    kept = ~F.col("duplicate")
    return flagged.agg(
        F.count("*").alias("rows"),
        F.count_if("duplicate").alias("duplicates"),
        F.count_if(ok).alias("valid"),
        F.count_if(kept & F.col("error").isNotNull()).alias("invalid"),
        F.round(F.sum(F.when(kept, F.col(hours)).otherwise(0)) / 3600.0, 2).alias("hours_all"),
        F.round(F.sum(F.when(ok, F.col(hours)).otherwise(0)) / 3600.0, 2).alias("hours_valid"),
    )


def dataset_statistics(rows: DataFrame, dataset: str, duration: str) -> DataFrame:
    """Counts and sums by dataset and over all (rollup)."""
    out = rows.rollup(dataset).agg(F.grouping(dataset).alias("is_total"), F.count("*").alias("n"), F.sum(duration).alias("total"), F.min(duration).alias("least"), F.max(duration).alias("most"))
    return out.withColumn("is_total", F.col("is_total").cast("int"))


def completeness(machines: int, checkpoints: DataFrame, manifests: DataFrame) -> DataFrame:
    """State of every machine id: complete, partial or missing."""
    ids = checkpoints.sparkSession.range(machines).withColumnRenamed("id", "machine_id")
    c = checkpoints.groupBy("machine_id").agg(F.count("*").alias("n_checkpoint"))
    m = manifests.groupBy("machine_id").agg(F.count("*").alias("n_manifest"))
    j = ids.join(c, "machine_id", "left").join(m, "machine_id", "left")
    state = F.when(F.col("n_checkpoint").isNotNull() & F.col("n_manifest").isNotNull(), "complete").when(F.col("n_checkpoint").isNotNull() | F.col("n_manifest").isNotNull(), "partial").otherwise("missing")
    return j.select("machine_id", state.alias("state"), F.coalesce("n_manifest", F.lit(0)).alias("n_manifest"))


def deal_out(rows: DataFrame, order: list[Column], machines: int) -> DataFrame:
    """Round-robin of ordered rows over machines.

    The rank of a row is the rank of its partition plus its place there, by a
    range sort; no single task sees all rows.
    """
    return global_rank(rows, order).withColumn("machine", (F.col("rank") % machines).cast("int"))


def global_rank(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their 0-based ``rank`` in the order (which must be total)."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND((1 << 33) - 1))
    placed = stored(placed)
    sizes = sorted((r._part, r["count"]) for r in placed.groupBy("_part").count().collect())  # a row a partition
    base, at = [], 0
    for part, n in sizes:
        base.append((part, at))
        at += n
    bases = rows.sparkSession.createDataFrame(base, "_part long, _base long")
    return placed.join(F.broadcast(bases), "_part").withColumn("rank", F.col("_base") + F.col("_at")).drop("_m", "_part", "_at", "_base")


def next_fit(rows: DataFrame, group: str, size: str, order: list[str], capacity: float, most: int) -> DataFrame:
    """Next-fit batches of ordered rows within groups, as a scan over blocks of ``most`` rows.

    Rows have a global rank in the order of (group, order). As a batch has at most
    ``most`` rows, a batch that starts in a block of so many ranks is followed by one
    that starts in the same block or the next. So a block is a function from the
    place of its first start to that of the next block, and the number of batches
    between. Such functions are composed level by level, ``FAN`` at a time, and the
    starts are handed down again: no group is ever in one task, whatever its size,
    and each level reads a ``FAN``-th of the last. An array holds 2 * ``most`` rows
    at most.
    """
    ranked = global_rank(rows, [F.col(group).asc(), *(F.col(c).asc() for c in order)])
    row = F.struct("rank", F.struct(*rows.columns).alias("row"), F.col(group).alias("g"), F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("s"))
    blocks = ranked.groupBy(F.expr(f"rank div {most}").alias("b")).agg(F.array_sort(F.collect_list(row)).alias("own"))
    blocks = stored(blocks)
    ends = blocks.select((F.col("b") + 1).alias("b"), F.col("own")[F.size("own") - 1]["g"].alias("_g"))  # the last group of the block before
    after = blocks.select((F.col("b") - 1).alias("b"), F.transform("own", lambda x: F.struct(x["g"].alias("g"), x["s"].alias("s"))).alias("_after"))
    all_rows = F.concat(F.transform("own", lambda x: F.struct(x["g"].alias("g"), x["s"].alias("s"))), F.coalesce("_after", F.array().cast(after.schema["_after"].dataType)))
    b = blocks.join(after, "b", "left").join(ends.withColumn("_known", F.lit(True)), "b", "left").withColumn("_x", all_rows).withColumn("_n", F.size("own"))
    b = b.withColumn("_first", F.transform("own", lambda x, i: F.when(i > 0, ~F.col("own")[F.greatest(i - 1, F.lit(0))]["g"].eqNullSafe(x["g"])).otherwise(F.col("_known").isNull() | ~F.col("_g").eqNullSafe(x["g"]))))

    def stop(i: Column) -> Column:
        """Where the batch after one that starts at place i starts."""

        def take(acc: Column, k: Column) -> Column:
            x = F.get("_x", i + k)
            full = (k == most) | (i + k >= F.size("_x")) | ~x["g"].eqNullSafe(F.get("_x", i)["g"]) | (acc["sum"] + x["s"] > capacity)
            return F.when(acc["stop"].isNotNull(), acc).when(F.coalesce(full, F.lit(True)), F.struct(acc["sum"].alias("sum"), (i + k).alias("stop"))).otherwise(F.struct((acc["sum"] + x["s"]).alias("sum"), F.lit(None).cast("int").alias("stop")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.struct(F.get("_x", i)["s"].alias("sum"), F.lit(None).cast("int").alias("stop")), take, lambda acc: acc["stop"])

    b = b.withColumn("_stop", F.transform(F.sequence(F.lit(0), F.col("_n") - 1), stop))

    def prepend(acc: Column, p: Column) -> Column:
        """Puts the way out from place p before those from the places behind it."""
        end, first = F.col("_stop")[p], F.col("_first")[p]
        then = F.get(acc, end - p - 1)
        inside = F.struct(then["p"].alias("p"), (first | then["r"]).alias("r"), F.when(then["r"], then["c"]).otherwise(then["c"] + F.when(first, 0).otherwise(1)).cast("long").alias("c"))
        return F.concat(F.array(F.when(end < F.col("_n"), inside).otherwise(F.struct((end - F.col("_n")).alias("p"), first.alias("r"), F.when(first, 0).otherwise(1).cast("long").alias("c")))), acc)

    ways = F.aggregate(F.reverse(F.sequence(F.lit(0), F.col("_n") - 1)), F.array().cast(f"array<{WAY}>"), prepend)
    b = stored(b.select("b", "own", "_n", "_first", "_stop", ways.alias("f")))

    def then(state: Column, f: Column) -> Column:
        """A state (place, whether a group began, batches since) carried through a function."""
        x = F.get(f, state["p"])
        return F.struct(x["p"].alias("p"), (state["r"] | x["r"]).alias("r"), F.when(x["r"], x["c"]).otherwise(state["c"] + x["c"]).alias("c"))

    levels = [b.select("b", "f")]
    n = levels[0].count()
    while n > 1:  # log n to the base FAN
        fs = F.transform(F.array_sort(F.collect_list(F.struct("b", "f"))), lambda x: x["f"])
        start = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.struct(p.alias("p"), F.lit(False).alias("r"), F.lit(0).cast("long").alias("c")))
        up = levels[-1].groupBy(F.expr(f"b div {FAN}").alias("b")).agg(fs.alias("fs")).withColumn("f", F.aggregate("fs", start, lambda acc, f: F.transform(acc, lambda s: then(s, f))))
        levels.append(stored(up))
        n = levels[-1].count()
    into = rows.sparkSession.range(1).select(F.col("id").alias("b"), F.struct(F.lit(0).alias("p"), F.lit(False).alias("r"), F.lit(-1).cast("long").alias("c")).alias("into"))
    for level in reversed(levels[1:]):
        steps = F.aggregate("fs", F.array("into"), lambda acc, f: F.concat(acc, F.array(then(F.element_at(acc, -1), f))))
        each = level.join(into, "b").select("b", F.posexplode(F.slice(steps, 1, F.size("fs"))).alias("k", "into"))
        into = each.select((F.col("b") * FAN + F.col("k")).alias("b"), "into")

    def number(acc: Column, i: Column) -> Column:
        starts = acc["at"] == i
        now = F.when(starts, F.when(F.col("_first")[i], F.lit(0).cast("long")).otherwise(acc["n"] + 1)).otherwise(acc["n"])
        return F.struct(F.when(starts, F.col("_stop")[i]).otherwise(acc["at"]).alias("at"), now.alias("n"), F.concat(acc["out"], F.array(now.cast("int"))).alias("out"))

    begin = F.struct(F.col("into.p").alias("at"), F.col("into.c").alias("n"), F.array().cast("array<int>").alias("out"))
    out = b.join(into, "b").withColumn("_batch", F.aggregate(F.sequence(F.lit(0), F.col("_n") - 1), begin, number, lambda acc: acc["out"]))
    return out.select(F.explode(F.arrays_zip(F.col("own.row").alias("row"), F.col("_batch").alias("batch"))).alias("z")).select("z.row.*", F.col("z.batch").alias("batch"))


def full_batches(ranked: DataFrame, size: int) -> DataFrame:
    """Batches of ``size`` by rank; an incomplete last one is dropped."""
    b = ranked.withColumn("batch", F.floor(F.col("rank") / size))
    full = b.groupBy("batch").count().filter(F.col("count") == size).select("batch")
    return b.join(full, "batch", "left_semi")


def resolve(wanted: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """The existing candidate of least priority of each wanted id; null if none."""
    have = candidates.join(files.select("path").distinct(), "path", "left_semi").groupBy("id").agg(F.min_by("path", "priority").alias("resolved"))
    return wanted.join(have, "id", "left")


def by_basename(missing: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the same base name for missing paths, the least path first."""
    base = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    f = files.groupBy(base(F.col("path")).alias("base")).agg(F.min("path").alias("found"))
    return missing.withColumn("base", base(F.col("path"))).join(f, "base", "left").drop("base")


def retention(dirs: DataFrame, key: str, keep: int) -> DataFrame:
    """Rows beyond the newest ``keep`` of each key, to be deleted."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.col("step").desc()))
    return dirs.withColumn("_r", r).filter(F.col("_r") > keep).drop("_r")


def writer_inventory(files: DataFrame) -> DataFrame:
    """Files by output folder."""
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")).agg(F.count("*").alias("n_files"))


def own_lines(lines: DataFrame, order: str, world: int, rank: int) -> DataFrame:
    """The rows of one of ``world`` readers: those whose place ``order`` is ``rank`` modulo ``world``."""
    return lines.filter(F.pmod(F.col(order), F.lit(world)) == rank)


def unify(manifests: list[DataFrame], names: list[str], sort_by: list[str] | None = None, seed: int | None = None) -> DataFrame:
    """Manifests one after another under their dataset's name, with a place ``n``.

    In the given order of datasets and of their column ``line``; sorted by
    ``sort_by``, or shuffled by md5 of seed, dataset and line, if asked for.
    """
    every = None
    for k, (m, name) in enumerate(zip(manifests, names, strict=True)):
        part = m.withColumn("dataset", F.lit(name)).withColumn("_d", F.lit(k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    order = [F.col(c).asc_nulls_last() for c in sort_by or []]
    if seed is not None:
        order = [F.md5(F.concat_ws(":", F.lit(str(seed)), "dataset", F.col("line").cast("string"))).asc()]
    return global_rank(every, [*order, F.col("_d").asc(), F.col("line").asc()]).withColumnRenamed("rank", "n").drop("_d")


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in order, as a smoke check reads them."""
    return rows.orderBy(*order).limit(n)


def smoke_checks(entries: DataFrame, files: DataFrame, order: list[str], n_paths: int = 100, n_documents: int = 3) -> DataFrame:
    """Per check how many of the first entries were looked at, failed, and which.

    The first ``n_paths`` entries' audio_path must be among ``files`` (path), the
    first ``n_documents`` entries' alignment must be well formed.
    """
    ids = lambda bad: F.array_sort(F.array_compact(F.collect_list(F.when(bad, F.col("id"))))).alias("failed_ids")
    there = files.select(F.col("path").alias("audio_path"), F.lit(True).alias("_there")).distinct()
    paths = first_rows(entries, order, n_paths).join(there, "audio_path", "left")
    lost, wrong = F.col("_there").isNull(), alignment_error("alignment").isNotNull()
    a = paths.agg(F.lit("paths").alias("check"), F.count("*").alias("looked_at"), F.count_if(lost).alias("failed"), ids(lost))
    b = first_rows(entries, order, n_documents).agg(F.lit("alignments").alias("check"), F.count("*").alias("looked_at"), F.count_if(wrong).alias("failed"), ids(wrong))
    return a.unionByName(b)


def training_entry_error(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``error``: the first reason why an entry can't be trained on.

    In order: no path, audio that isn't among ``files`` (path), no alignment,
    one that doesn't parse or lacks its key, an empty one.
    """
    there = files.select(F.col("path").alias("path"), F.lit(True).alias("_there")).distinct()
    broken = alignment_error("alignment")
    empty = F.size(F.from_json("alignment", "alignments array<string>")["alignments"]) <= 0
    error = F.when(F.coalesce("path", F.lit("")) == "", "no_path").when(F.col("_there").isNull(), "missing_audio").when(F.col("alignment").isNull(), "missing_alignment").when(broken.isNotNull(), broken).when(empty, "empty_alignment")
    return entries.join(there, "path", "left").withColumn("error", error).drop("_there")


def speaker_files_error(entries: DataFrame, files: DataFrame, speakers: list[str]) -> DataFrame:
    """Adds ``missing``: the speakers of ``speakers`` without a file (id, speaker) of an entry."""
    have = files.groupBy("id").agg(F.collect_set("speaker").alias("_have"))
    wanted = F.array(*map(F.lit, speakers)).cast("array<string>")
    return entries.join(have, "id", "left").withColumn("missing", F.array_except(wanted, F.coalesce("_have", F.array().cast("array<string>")))).drop("_have")


def validation_report(checked: DataFrame, most: int = 100) -> DataFrame:
    """Counts of entries (id, error), and the first ids that repeat and of each error.

    Lists end after ``most`` ids; the counts don't.
    """
    n = checked.groupBy("id").agg(F.count("*").alias("n"))
    twice = n.filter("n > 1").select(F.lit("duplicate").alias("problem"), "id")
    wrong = checked.filter("error IS NOT NULL").select(F.col("error").alias("problem"), "id")
    both = twice.unionAll(wrong)
    counts = both.groupBy("problem").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("problem").orderBy("id"))
    first = both.withColumn("_r", place).filter(F.col("_r") <= most).groupBy("problem").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return counts.join(first, "problem")
