"""One query for each operation, over whole tables; levels stand for `documents`, samples for `conversations`."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import grid, tokens
from gridspark.operators import dataset, growing, labelling, neighbours, rewards, sampling, scoring
from gridspark.operators.rounds import cut, shared_folder
from gridspark.sources import files
from gridspark.sources.files import byte_of, table_levels, table_samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Fixed edges for queries on samples; those of the levels come from their quantiles.
EDGES = (10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 75.0, 90.0, 105.0)
SPLITS = ("test", "val", "hard", "train")
MIDDLES = {b: float(5 + 12 * b) for b in range(10)}


def query(f):
    QUERIES[f.__name__] = f
    return f


def per_level(name: str, *columns):
    QUERIES[name] = lambda spark, d: table_levels(spark, d).select("id", *(c() for c in columns))


text = lambda: F.col("text")
# Faulty variants of a text, so that parsing and normalising have work to do: by id, ragged, dashed or cut.
broken = lambda: F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("\n"), F.when(F.col("doc_id") % 8 == 0, "-_-\n").otherwise(""), F.translate(F.rtrim(F.col("text")), " ", "-"), F.lit("\r\n\n"))).when(F.col("doc_id") % 4 == 1, F.regexp_replace("text", "#\n#", "\n#")).when(F.col("doc_id") % 4 == 2, F.translate("text", "$", "x")).otherwise(F.col("text"))
bucket = lambda: F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") % 10).cast("int")
path = lambda: F.translate(F.md5(F.col("id")), "0123456789abcdef", "lurdLURDlurdlurd")

per_level("fn1_valid", lambda: grid.is_valid(text()).alias("valid"))
per_level("fn2_counts", lambda: grid.players(text()).alias("players"), lambda: grid.boxes(text()).alias("boxes"), lambda: grid.goals(text()).alias("goals"), lambda: grid.count_of(text(), "#").alias("walls"))
per_level("fn3_parse_error", lambda: grid.parse_error(grid.normalised(broken())).alias("error"))
per_level("fn4_normalised", lambda: grid.normalised(broken()).alias("text"))
per_level("fn5_transform", lambda: grid.transform(text(), (F.col("doc_id") % 8).cast("int")).alias("image"))
per_level("fn6_orbit", lambda: F.array_join(grid.orbit(text()), "|").alias("images"))
per_level("fn7_canonical", lambda: grid.canonical(text()).alias("canonical"))
per_level("fn8_condition", lambda: tokens.condition(bucket()).alias("token"))
per_level("fn9_encode", lambda: F.array_join(tokens.encode(text(), bucket()), " ").alias("tokens"))
per_level("fn10_decode", lambda: tokens.decode(F.when(F.col("doc_id") % 3 == 0, F.slice(tokens.encode(text(), bucket()), 1, 90)).otherwise(tokens.encode(text(), bucket()))).alias("text"))
per_level("fn11_level_id", lambda: F.col("file"), lambda: F.col("index"))
per_level("fn15_path_counts", lambda: grid.path_moves(path()).alias("moves"), lambda: grid.path_pushes(path()).alias("pushes"))


def solved(spark, d):
    return dataset.kept(table_levels(spark, d))


def edges(spark, d):
    return dataset.edges_of(solved(spark, d).where("split = 'train'"))


def fixed_edges(spark):
    return spark.range(1).select(F.array(*map(F.lit, EDGES)).alias("edges"))


def kept_rows(spark, d):
    """What both the edges and the buckets read, written once."""
    return cut(solved(spark, d).select("id", "split", "moves", "text"))


def in_buckets(spark, d):
    rows = kept_rows(spark, d)
    return dataset.bucketed(rows, dataset.edges_of(rows.where("split = 'train'")))


@query
def fn12_bucket(spark, d):
    return in_buckets(spark, d).select("id", F.col("bucket").cast("int").alias("bucket"))


@query
def fn13_bucket_labels(spark, d):
    return edges(spark, d).select(F.posexplode(grid.bucket_labels(F.col("edges"))).alias("bucket", "label"))


@query
def fn16_status(spark, d):
    return table_samples(spark, d).select("sample_id", grid.sample_status(text(), grid.is_valid(text()), F.col("solver_status")).alias("status"))


@query
def win1_dedup(spark, d):
    return dataset.deduplicated(table_levels(spark, d)).select("id", "split", "outcome")


def grown(spark, d):
    """A store of all levels, added split by split, the last in level order first."""
    rows, path = cut(table_levels(spark, d)), f"{folder(spark)}/store"
    for split in reversed(SPLITS):
        growing.add_source(rows.where(F.col("split") == split), path, split)
    return path


@query
def win1_by_source(spark, d):
    """Deduplication that grows by a split at a time, earlier levels coming later."""
    return growing.outcomes(spark, grown(spark, d)).select("id", "split", "outcome")


@query
def set2_first_levels(spark, d):
    """The canonical forms of the same store, each with its first level."""
    return growing.forms(spark, grown(spark, d))


@query
def win2_ordinal_rank(spark, d):
    rows = table_levels(spark, d).select("split", "moves", F.col("doc_id").alias("sample_id"))
    return scoring.ordinal_rank(rows, "moves", "rank", "split")


@query
def win3_first_of_source(spark, d):
    return dataset.first_of_source(table_levels(spark, d), 25).select("id")


@query
def agg1_source_stats(spark, d):
    return dataset.source_stats(table_levels(spark, d))


@query
def agg2_split_stats(spark, d):
    return dataset.split_stats(table_levels(spark, d))


@query
def agg3_edges(spark, d):
    return edges(spark, d).select(F.posexplode("edges").alias("k", "edge"))


@query
def agg4_move_stats(spark, d):
    return dataset.move_stats(solved(spark, d))


@query
def agg5_bucket_counts(spark, d):
    """The flagship: levels of each difficulty bucket and split after deduplication."""
    return dataset.bucket_counts(in_buckets(spark, d))


@query
def snk5_bucket_card(spark, d):
    rows = kept_rows(spark, d)
    cuts = dataset.edges_of(rows.where("split = 'train'"))
    return dataset.bucket_card(dataset.bucketed(rows, cuts), cuts)


@query
def snk3_edges(spark, d):
    """The bucket edges as a job writes and reads them."""
    rows = edges(spark, d).select("edges", F.size("edges").alias("n_edges"))
    files.write_json(rows, path := f"{folder(spark)}/edges")
    return files.read_json(spark, path, rows).select("n_edges", F.posexplode("edges").alias("k", "edge"))


@query
def src1_level_files(spark, d):
    """The levels as level files, written and read by split (SRC-1, SRC-2)."""
    files.write_levels(table_levels(spark, d), path := f"{folder(spark)}/levels")
    parts = [files.read_levels(spark, f"{path}/split={s}", s) for s in SPLITS]
    return reduce(DataFrame.unionByName, parts)


@query
def src3_split_read(spark, d):
    """Chosen columns of one split of a dataset that is partitioned by split."""
    files.write_splits(in_buckets(spark, d), path := f"{folder(spark)}/splits")
    return files.read_split(spark, path, "train", "id", F.col("bucket").cast("int").alias("bucket"))


@query
def snk2_splits(spark, d):
    """All splits as a job writes and reads them."""
    files.write_splits(in_buckets(spark, d), path := f"{folder(spark)}/splits")
    return spark.read.parquet(path).select("split", "id", "text", F.col("bucket").cast("int").alias("bucket"))


@query
def src4_samples(spark, d):
    """The samples as JSON lines, written and read."""
    files.write_json(table_samples(spark, d).select("sample_id", "target", "text"), path := f"{folder(spark)}/samples")
    return files.read_samples(spark, path)


@query
def src5_external_labels(spark, d):
    """Label files in CSV, two for each key: the one that comes last by name counts."""
    rows, path = theirs(spark, d).select(F.col("file").alias("File"), F.col("index").alias("Level"), F.col("steps").alias("Steps")), f"{folder(spark)}/labels"
    for name, steps in (("a", F.lit("open")), ("b", F.col("Steps"))):
        rows.withColumn("Steps", steps).write.option("header", True).option("compression", "gzip").csv(f"{path}/{name}")
    return files.read_external_labels(spark, f"{path}/*")


@query
def agg14_nearest_rank(spark, d):
    return dataset.nearest_rank(table_levels(spark, d), "nodes_expanded", (0.5, 0.99))


@query
def agg15_status_share(spark, d):
    return dataset.status_share(table_levels(spark, d))


@query
def agg16_effort(spark, d):
    return dataset.effort(solved(spark, d))


@query
def set1_union(spark, d):
    rows = table_levels(spark, d)
    return rows.where("split = 'val'").unionByName(rows.where("split = 'test'")).select("id", "split")


@query
def set2_canonicals(spark, d):
    return table_levels(spark, d).select("canonical").distinct()


@query
def ord2_first_of_split(spark, d):
    return dataset.first_of_split(table_levels(spark, d), "train", 100).select("id")


@query
def smp1_fraction(spark, d):
    return sampling.fraction(table_levels(spark, d).select("id"), 0.3, "seed")


@query
def smp2_sequences(spark, d):
    return sampling.sequences(in_buckets(spark, d)).select("id", F.array_join("tokens", " ").alias("tokens"))


@query
def smp3_augment(spark, d):
    return sampling.picked_image(table_levels(spark, d), "seed")


@query
def smp4_dropout(spark, d):
    return table_levels(spark, d).select("id", tokens.dropped(bucket(), 0.1, "seed", F.col("id")).alias("bucket"))


@query
def smp5_draws(spark, d):
    return sampling.draws(table_levels(spark, d).select("id"), 40, 64, "seed")


@query
def smp6_expanded(spark, d):
    return sampling.expanded(table_levels(spark, d))


@query
def smp7_plan(spark, d):
    n = table_samples(spark, d).count()
    return sampling.evaluation_plan(spark, n // 20, n // 10)


@query
def smp8_oversampled(spark, d):
    return sampling.oversampled(in_buckets(spark, d), {8: 2.5, 9: 3.0, 0: 0.5}, "seed").select("id", "copy")


def folder(spark):
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/job-{uuid4().hex}"


def corpus(spark, d):
    return cut(solved(spark, d).where("split = 'train'").select("text", "canonical"))


def scores(spark, d):
    """Scored samples; the tables that several joins read are materialised first, as a job would write them."""
    return cut(scoring.scored(cut(table_samples(spark, d)), corpus(spark, d), fixed_edges(spark)))


@query
def join1_novel(spark, d):
    return neighbours.novel(table_samples(spark, d), corpus(spark, d)).select("sample_id", "novel")


@query
def join1_bucketed(spark, d):
    """Novelty against a corpus that is stored by canonical form and stays where it is."""
    known, name = solved(spark, d).where("split = 'train'").select("text", "canonical"), f"corpus_{uuid4().hex}"
    table = files.write_bucketed(known, name, f"{folder(spark)}/corpus", "canonical", int(spark.conf.get("spark.sql.shuffle.partitions")))
    return neighbours.novel(table_samples(spark, d), table).select("sample_id", "novel")


@query
def join2_nearest_edit(spark, d):
    asked = cut(table_samples(spark, d).where("sample_id % 50 = 0"))
    return neighbours.nearest_edit(asked, corpus(spark, d)).select("sample_id", "nearest")


@query
def join3_nearest_edit_symmetric(spark, d):
    asked = cut(table_samples(spark, d).where("sample_id % 50 = 0"))
    return neighbours.nearest_edit(asked, corpus(spark, d), symmetric=True).select("sample_id", "nearest")


@query
def join4_novel_k(spark, d):
    return neighbours.novel_k(cut(table_samples(spark, d)), corpus(spark, d)).select("sample_id", "novel_k")


@query
def join5_close_pairs(spark, d):
    return neighbours.close_pairs(cut(table_samples(spark, d)))


@query
def join5_close_links(spark, d):
    """The same by sample, with membership and copies."""
    return neighbours.close_links(cut(table_samples(spark, d)))


@query
def join6_scored(spark, d):
    return scores(spark, d).select("sample_id", "target", "valid", "status", "solved", "moves", "bucket", "novel_strict", "novel_k", "novel_exact")


@query
def snk4_scored_rows(spark, d):
    """Scored rows as a job writes and reads them, nulls kept."""
    rows = scores(spark, d).select("sample_id", "target", "text", "valid", "status", "moves", "bucket", "novel_strict")
    files.write_json(rows, path := f"{folder(spark)}/scored")
    return files.read_json(spark, path, rows)


@query
def join7_distances(spark, d):
    """nn_edit and nn_edit_sym of scored rows; the query set is every id that 50 divides."""
    asked = cut(table_samples(spark, d).where("sample_id % 50 = 0"))
    return scoring.with_distances(asked, corpus(spark, d)).select("sample_id", "nn_edit", "nn_edit_sym")


@query
def lbl2_valid_only(spark, d):
    rows = cut(table_samples(spark, d))
    labels = rows.where("text IS NOT NULL AND sample_id % 3 > 0").groupBy("text").agg(F.min_by(F.struct(F.col("solver_status").alias("status"), F.col("solver_moves").alias("moves")), "sample_id").alias("l")).select("text", "l.*")
    return labelling.valid_only(rows, labels)


@query
def agg8_summary(spark, d):
    return scoring.summary(scores(spark, d))


@query
def agg9_spearman(spark, d):
    return scoring.spearman(scoring.grouped(scores(spark, d)))


@query
def agg10_diversity(spark, d):
    rows = scoring.grouped(cut(table_samples(spark, d))).select("group", "sample_id", "text")
    return scoring.diversity(rows)


@query
def agg11_headline(spark, d):
    return scoring.headline(scores(spark, d))


@query
def agg12_confusion(spark, d):
    return scoring.confusion(scores(spark, d))


@query
def agg13_calibration(spark, d):
    return scoring.calibration(scores(spark, d), fixed_edges(spark))


def theirs(spark, d):
    rows = table_levels(spark, d)
    key = F.col("doc_id").cast("string")
    steps = F.when(byte_of(key, ":x") < 10, (F.col("moves") + 1).cast("string")).when(byte_of(key, ":x") < 20, "none").otherwise(F.col("moves").cast("string"))
    return rows.where(byte_of(key, ":y") > 12).select("file", "index", steps.alias("steps"))


@query
def lbl3_agreement(spark, d):
    rows = labelling.agreement(table_levels(spark, d), theirs(spark, d))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


@query
def ord1_examples(spark, d):
    return labelling.examples(labelling.agreement(table_levels(spark, d), theirs(spark, d)))


def label_table(levels):
    """Labels of most texts, each from its first document; the others have yet to be solved."""
    key = F.col("doc_id").cast("string")
    return levels.where(byte_of(key, ":z") > 12).groupBy("text").agg(F.min_by(F.struct("status", "moves"), "doc_id").alias("l")).select("text", "l.*")


@query
def lbl1_labels(spark, d):
    rows = cut(table_levels(spark, d).select("id", "doc_id", "text", "status", "moves"))
    return labelling.merged(rows.select("id", "text"), label_table(rows)).select("id", "status", "moves", "error")


@query
def snk1_label_cache(spark, d):
    """Two runs over one label table: the second labels only the texts that the first had not seen."""
    rows = cut(table_levels(spark, d).select("doc_id", "text", "status", "moves"))
    table, path = rows.groupBy("text").agg(F.min_by(F.struct("status", "moves"), "doc_id").alias("l")).select("text", "l.*"), f"{folder(spark)}/labels"
    for run, part in enumerate((rows.where("doc_id % 2 = 0"), rows)):
        found = files.cached_labels(part, path, lambda missing, run=run: missing.join(table, "text").withColumn("run", F.lit(run)), "table", 1000)
    return found.select("text", "status", "moves", "run")


def rewarded(spark, d):
    return rewards.rewards(scores(spark, d), MIDDLES).withColumn("group_id", F.floor(F.col("sample_id") / 16000))


REWARD = ("sample_id", "r_valid", "r_playable", "r_match", "r_novel", "total")


@query
def rwd1_rewards(spark, d):
    return rewarded(spark, d).select(*REWARD)


@query
def rwd2_copies(spark, d):
    return rewards.copy_penalty(rewarded(spark, d)).select("sample_id", "r_copies")


@query
def rwd3_advantages(spark, d):
    return rewards.advantages(rewarded(spark, d)).select("sample_id", "advantage")


@query
def rwd4_informative(spark, d):
    return rewards.informative(rewarded(spark, d)).select("sample_id", "group_id")


@query
def rwd5_selected(spark, d):
    return rewards.selected(scores(spark, d)).select("sample_id", "target")


@query
def rwd6_runs(spark, d):
    rows = scores(spark, d)
    rows = rows.withColumn("run", F.concat(F.lit("run"), F.pmod("sample_id", F.lit(2)).cast("string")))
    return rewards.runs_table(rows, "run", {"run0": {"cost": 1.5, "latency": None}, "run1": {"cost": 2.0, "latency": 30.0}})
