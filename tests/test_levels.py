"""Level functions and operators on small hand-written levels."""

import gzip
import random

from pyspark.sql import functions as F

from gridspark.functions import grid, tokens
from gridspark.jobs import queries
from gridspark.operators import dataset, labelling, neighbours, scoring
from gridspark.sources import files

ROOM = "#######\n# @ . #\n##$ ###\n#######"


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "text string").select(*columns).first()


def test_orbit_has_eight_images_and_one_canonical(spark):
    images = one(spark, ROOM, grid.orbit(F.col("text")))[0]
    assert len(set(images)) == 8
    rows = spark.createDataFrame([(x,) for x in images], "text string")
    assert rows.select(grid.canonical(F.col("text"))).distinct().count() == 1
    assert one(spark, "#.#\n##", grid.canonical(F.col("text")))[0] is None
    assert one(spark, ROOM, grid.transform(F.col("text"), 8))[0] is None


def test_normalised_and_faults(spark):
    text = F.col("text")
    assert one(spark, " \n\n#_#\r\r\n##-$.\n   \n*\n \t\n", grid.normalised(text))[0] == "# #  \n## $.\n     \n*    "
    assert one(spark, "---\n#@#\n__", grid.normalised(text))[0] == "   \n#@#\n   "
    assert one(spark, "\n  \n", grid.normalised(text))[0] == ""
    fault = lambda x: one(spark, x, grid.parse_error(text))[0]
    assert fault("") == fault(None) == "empty"
    assert fault("####\n#x #") == "unknown tile at row 1 column 1"
    assert fault("#$.#") == "players"
    assert fault("#@ #") == "no boxes"
    assert fault("#@$#") == "boxes and goals"
    assert fault("#@$.#") is None
    assert fault("\n".join(["#" * 13] * 10)) == "too large"


def test_validity_agrees_with_parsing_on_fuzzed_grids(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        cells = rng.choices("# ", k=100)
        for tile in rng.choice(["@$.", "@$", "+$", "@$$..", "*@", "@@$."]):
            cells[rng.randrange(100)] = tile
        rows.append((i, "\n".join("".join(cells[10 * r : 10 * r + 10]) for r in range(10))))
    df = spark.createDataFrame(rows, "id int, text string")
    assert df.where(grid.is_valid(F.col("text")) != grid.parse_error(F.col("text")).isNull()).count() == 0


def test_tokens_round_trip_and_rejection(spark):
    rows = files.grid_of(F.col("id").cast("string"))
    df = spark.range(50).select(rows.alias("text"), (F.col("id") % 10).cast("int").alias("bucket"))
    assert df.where(tokens.decode(tokens.encode(F.col("text"), F.col("bucket"))) != F.col("text")).count() == 0
    assert df.where(tokens.encode(F.col("text"), F.lit(10)).isNotNull()).count() == 0
    assert one(spark, ROOM, tokens.encode(F.col("text"), F.lit(1)))[0] is None


def test_range_labels(spark):
    edges = F.array(*map(F.lit, (7.0, 9.5, 30.0, 31.0)))
    assert spark.range(1).select(grid.bucket_labels(edges, "upper")).first()[0] == ["≤ 7", "8–9", "10–30", "31", "≥ 32"]
    assert spark.range(1).select(grid.bucket_labels(edges)).first()[0] == ["≤ 6", "7–9", "10–29", "30", "≥ 31"]


def test_unsolved_first_copy_blocks_later_ones(spark):
    rows = [(0, 0, 1, 1, "a", "x", "unsolvable"), (0, 0, 1, 2, "b", "x", "solved"), (3, 9, 1, 1, "c", "y", "solved")]
    df = spark.createDataFrame(rows, "split_rank int, source_rank int, file int, index int, id string, canonical string, status string")
    assert {r["id"]: r["outcome"] for r in dataset.deduplicated(df).collect()} == {"a": "unsolved", "b": "duplicate", "c": "kept"}


def test_any_solver_labels_each_text_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def solver(texts, max_nodes):
        seen.add(len(texts))
        return [("solved", x.count(" "), 0, "", max_nodes) for x in texts]

    texts = [ROOM, ROOM, ROOM.replace("@", "-"), None]
    rows = labelling.label(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), 7, solver, parts=2).collect()
    rows.sort(key=lambda r: r["i"])
    assert [(r["status"], r["moves"], r["nodes_expanded"], r["error"]) for r in rows] == [("solved", 4, 7, None)] * 2 + [("invalid", 0, 0, "players"), ("invalid", 0, 0, "empty")]
    assert seen.value == 1


def test_labels_take_whole_levels(spark):
    d = "/root/testdata/sf0.001"
    levels = files.table_levels(spark, d).select("id", grid.is_valid(F.col("text")).alias("valid")).collect()
    labels = queries.lbl1_labels(spark, d).collect()
    assert len(labels) == len(levels) and {r["id"] for r in labels if r["status"] != "invalid"} == {r["id"] for r in levels if r["valid"]}
    assert {"solved", "unlabelled", "invalid"} <= {r["status"] for r in labels}


def test_only_valid_samples_meet_the_label_table(spark):
    good = files.grid_of(F.lit("5"))
    rows = spark.range(4).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 2, good).when(F.col("id") == 2, "###").alias("text"))
    text = rows.first()["text"]
    valid = one(spark, text, grid.is_valid(F.col("text")))[0]
    table = spark.createDataFrame([(text, "solved", 9), ("###", "solved", 1)], "text string, status string, moves int")
    got = {r["sample_id"]: (r["status"], r["moves"]) for r in labelling.valid_only(rows, table).collect()}
    assert got == {0: ("solved", 9) if valid else ("invalid", None), 1: got[0], 2: ("invalid", None), 3: ("undecodable", None)}


def test_label_cache_appends_and_is_used_again(spark, tmp_path):
    asked = []

    def label(missing):
        asked.append(sorted(r["text"] for r in missing.collect()))
        return missing.withColumn("status", F.lit("solved"))

    for texts in (["a", "b", "a"], ["b", "c"], ["c"]):
        out = files.cached_labels(spark.createDataFrame([(x,) for x in texts], "text string"), str(tmp_path / "cache"), label)
    assert asked == [["a", "b"], ["c"], []] and sorted(r["text"] for r in out.collect()) == ["a", "b", "c"]


def test_ordinal_ranks_of_a_frequent_value(spark):
    rng = random.Random(8)
    rows = [(i * i, rng.choice([1, 1, 1, 1, 2, 3])) for i in rng.sample(range(5000), 800)]
    got = {r["sample_id"]: r["rank"] for r in scoring.ordinal_rank(spark.createDataFrame(rows, "sample_id long, v int"), "v", "rank").collect()}
    assert got == {i: k for k, (v, i) in enumerate(sorted((v, i) for i, v in rows))}


def test_json_keeps_nulls_and_types(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, [0.5, 1.25]), (2, "x", None)], "a long, b string, c array<double>")
    files.write_json(rows, str(tmp_path / "rows"))
    back = files.read_json(spark, str(tmp_path / "rows"), rows)
    assert back.schema == rows.schema and sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_labels_merge_back(spark):
    texts = [ROOM, ROOM, ROOM.replace(" @", "@ "), ROOM.replace("$", " "), None]
    table = spark.createDataFrame([(ROOM, "solved", 1)], "text string, status string, moves int")
    got = labelling.merged(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), table).orderBy("i").collect()
    assert [(r["status"], r["moves"], r["error"] is None) for r in got] == [("solved", 1, True), ("solved", 1, True), ("unlabelled", None, True), ("invalid", 0, False), ("invalid", 0, False)]


def test_diversity_equals_the_sequential_greedy(spark):
    rng = random.Random(2)
    rows = []
    for g in range(4):
        base = ["".join(rng.choices("abcd", k=16)) for _ in range(4)]
        for i in range(20):
            x = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                x[rng.randrange(16)] = rng.choice("abcd")
            rows.append((f"g{g}", i, "".join(x)))
    # Copies in any order of ids, of texts in a chain: equal degrees meet, and nodes empty in turns.
    chain = ["a" * 8 + "b" * n + "a" * (8 - n) for n in range(7)]
    for g in range(4, 8):
        rows += [(f"g{g}", i, rng.choice(chain[: g - 1])) for i in rng.sample(range(100), 30)]
    rows += [("g8", i, chain[0]) for i in range(12)]
    rows.sort(key=lambda r: (r[0], r[1]))
    got = {r["group"]: r["diversity"] for r in scoring.diversity(spark.createDataFrame(rows, "group string, sample_id long, text string"), 3).collect()}

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    assert set(got) == {h for h, _, _ in rows}
    for g in got:
        left = [t for h, _, t in rows if h == g]
        while left:
            degree = [sum(distance(a, b) < 3 for j, b in enumerate(left) if j != i) for i, a in enumerate(left)]
            if not max(degree):
                break
            left.pop(degree.index(max(degree)))
        assert got[g] == len(left)


def test_near_pairs_find_all(spark):
    rng = random.Random(4)
    texts = list({"".join(rng.choices("ab#", k=rng.randint(6, 9))) for _ in range(60)})
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r["a"], r["b"]) for r in neighbours.close_pairs(df, 3).collect()}
    every = df.toDF("a").crossJoin(df.toDF("b")).where("a < b").where(F.levenshtein("a", "b") < 3)
    assert got == {(r["a"], r["b"]) for r in every.collect()}


def test_close_links_count_copies(spark):
    rng = random.Random(6)
    base = ["".join(rng.choices("ab#", k=7)) for _ in range(12)]
    rows = [(100 - i, rng.choice([*base, None])) for i in range(50)]
    got = {r["sample_id"]: (r["class_id"], r["links"]) for r in neighbours.close_links(spark.createDataFrame(rows, "sample_id long, text string"), 3).collect()}
    df = spark.createDataFrame(rows, "i long, t string")
    near = df.crossJoin(df.toDF("j", "u")).where("i <> j").where(F.levenshtein("t", "u") < 3).groupBy("i").count()
    links = {r["i"]: r["count"] for r in near.collect()}
    assert got == {i: (min(j for j, u in rows if u == t), links.get(i, 0)) if t is not None else (None, None) for i, t in rows}


def test_files(spark, tmp_path):
    (tmp_path / "017.txt").write_text("3\n#\n; 20\n#+#\n   \n#.#\n\n; 21\n#*##\r\n\n#  #\n;22\n")
    rows = files.read_levels(spark, str(tmp_path), "test").orderBy("index").collect()
    assert [(r["file"], r["index"], r["text"]) for r in rows] == [(17, 20, "#+#\n   \n#.#"), (17, 21, "#*##\n#  #"), (17, 22, "")]
    (tmp_path / "s.json").write_text('{"sample_id": 1, "target": 2, "text": "x"}\n\n{"sample_id": 2, "target": null, "text": null}\n')
    assert files.read_samples(spark, str(tmp_path / "s.json")).count() == 2
    (tmp_path / "labels").mkdir()
    for name, lines in (("b", "6,2,31\n"), ("a", "6,2,8\n6,2,12\n6,3,open\n")):
        with gzip.open(tmp_path / "labels" / f"{name}.csv.gz", "wt") as f:
            f.write("File,Level,Steps\n" + lines)
    labels = {(r["file"], r["index"]): r["steps"] for r in files.read_external_labels(spark, str(tmp_path / "labels")).collect()}
    assert labels == {(6, 2): "31", (6, 3): "open"}
    levels = spark.createDataFrame([("a", "x", "test"), ("b", "y", "train")], "id string, text string, split string")
    files.write_splits(levels, str(tmp_path / "out"))
    assert files.read_split(spark, str(tmp_path / "out"), "train", "id").collect()[0][0] == "b"
    assert files.unlabelled(levels, levels.where("id = 'a'"), "text").count() == 1
