import math
import os
import random
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kindred import commands
from kindred import queries as engine
from kindred.config import MULTIPLE, NONE_ID, SINGLE, SYMBOLS, read_env_file
from kindred.functions import distance
from kindred.operators import cosine, fuzzy, pairs, tfidf
from kindred.plans import dumps, indexes, lookup, mapping
from kindred.sources import scratch, tables
from kindred.streaming import serve

SF = "/root/testdata/sf0.001"


def plain_search(docs, query, threshold=0.7):
    """Top hits of one index in plain code."""
    grams = lambda t: Counter(t[:30].ljust(3)[i : i + 3] for i in range(max(1, len(t[:30]) - 2)))
    df = Counter(g for _, t in docs for g in grams(t))
    idf = {g: math.log((len(docs) + 1) / (n + 1)) + 1 for g, n in df.items()}

    def vector(t):
        v = {g: n * idf[g] for g, n in grams(t).items() if g in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()} if size else {}

    q = vector(query)
    hits = [(round(sum(w * vector(t).get(g, 0) for g, w in q.items()), 6), p, t) for p, (_, t) in enumerate(docs)]
    hits = sorted((h for h in hits if h[0] >= threshold), key=lambda h: (-h[0], h[1]))
    k = 10
    while k < 1000 and len(hits[:k]) == k and all(h[0] >= 1 for h in hits[:k]):
        k += 10
    return [(p, c) for c, p, _ in hits[:k]]


def test_search_against_plain_code(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(60)]
    docs = [(k, r.choice(words) + r.choice(words)) for k in range(80)] + [(100 + k, "samename") for k in range(25)]
    asked = [d[1] for d in docs[:10]] + ["samename", "samenamf", "zzzz", "a", ""]
    index = fuzzy.build_index(spark.createDataFrame([(0, p, i, t) for p, (i, t) in enumerate(docs)], "index_id long, pos long, entity_id long, text string"))
    got = fuzzy.search(spark.createDataFrame([(q, 0, t) for q, t in enumerate(asked)], "q long, index_id long, text string"), index).collect()
    for q, t in enumerate(asked):
        assert [(x.pos, x.confidence) for x in sorted(got, key=lambda x: x.rank) if x.q == q] == plain_search(docs, t)
    assert sum(x.q == 10 for x in got) == 30 - 5  # all 25 perfect hits


def test_long_texts_are_ranked_by_distance(spark):
    base = "averylongnameofmorethanthirtyletters"
    index = fuzzy.build_index(spark.createDataFrame([(0, 0, 1, base + "x"), (0, 1, 2, base + "different"), (0, 2, 3, "unrelated")], "index_id long, pos long, entity_id long, text string"))
    got = fuzzy.search(spark.createDataFrame([(0, 0, base + "y")], "q long, index_id long, text string"), index).orderBy("rank").collect()
    assert [(x.entity_id, x.confidence) for x in got] == [(1, round(1 - 2 / 37, 6)), (2, round(1 - 10 / 37, 6))]


@pytest.mark.parametrize("how", [tfidf.Vectorizer(), tfidf.Vectorizer(binary=True), tfidf.Vectorizer(use_idf=False), tfidf.Vectorizer(sublinear=True, norm="l1"), tfidf.Vectorizer(norm="none"), tfidf.Vectorizer(max_features=2)])
def test_vectorizer(spark, how):
    docs = spark.createDataFrame([(0, 0, 1, "aaaab"), (0, 1, 2, "bcd"), (1, 0, 3, "aaab")], "index_id long, pos long, entity_id long, text string")
    vocabulary, weights = tfidf.build(docs, how)
    rows = weights.collect()
    if how.norm == "l2":
        for key in {(x.index_id, x.pos) for x in rows}:
            assert abs(sum(x.w**2 for x in rows if (x.index_id, x.pos) == key) - 1) < 1e-9
    if how.max_features:
        assert vocabulary.filter("index_id = 0").count() == 2


def test_empty_index(spark):
    index = fuzzy.build_index(spark.createDataFrame([], "index_id long, pos long, entity_id long, text string"))
    assert fuzzy.search(spark.createDataFrame([(0, 0, "abc")], "q long, index_id long, text string"), index).collect() == []


FACTS = [
    # credit, name, release, release name, release credit, recording, recording name, score
    (10, "Blue Lanterns", 100, "First Light", 10, 1000, "Opening Song", 1),
    (10, "Blue Lanterns", 101, "Second Light", 10, 1000, "Opening Song", 2),
    (10, "Blue Lanterns", 101, "Second Light", 10, 1001, "Closing Song", 2),
    (11, "Red Lanterns", 102, "Gathering", 12, 1002, "Shared Song", 1),
    (12, "Many Voices", 102, "Gathering", 12, 1003, "Other Song", 1),
    (13, "!!!", 103, "Noise", 13, 1004, "Loud Thing", 1),
    (14, "Иванов", NONE_ID, "", NONE_ID, 1005, "Alone", NONE_ID),
]


@pytest.fixture(scope="module")
def small(spark):
    columns = "artist_credit_id long, artist_credit_name string, release_id long, release_name string, release_artist_credit_id long, recording_id long, recording_name string, score long"
    facts = spark.createDataFrame(FACTS, columns).selectExpr("*", "concat('a', artist_credit_id) AS artist_mbids", "'' AS artist_credit_sortname", "IF(release_name = '', '', concat('rel', release_id)) AS release_mbid", "concat('rec', recording_id) AS recording_mbid").cache()
    credits = facts.selectExpr("artist_credit_id AS id", "artist_credit_name AS name", "IF(artist_credit_id = 12, 2, 1) AS artist_count", "'' AS sort_name").distinct()
    creators = indexes.creator_docs(credits, spark.createDataFrame([(10, "Azure Lamps"), (10, "!?")], "id long, name string"))
    docs, links = indexes.block_docs(facts, spark.createDataFrame([(1001, "Farewell")], "recording_id long, name string"))
    index = [fuzzy.Index(x.docs.cache(), x.vocabulary.cache(), x.weights.cache()) for x in (fuzzy.build_index(creators.cache()), fuzzy.build_index(docs.cache()))]
    return lookup.Engine(facts, *index, links.cache())


CASES = [
    (("Blue Lanterns", "Second Light", "Opening Song"), (101, 1000)),
    (("Blu Lanterns", "Secnd Light", "Openin Song"), (101, 1000)),
    (("Blue Lanterns", "", "Opening Song"), (100, 1000)),  # canonical
    (("Blue Lanterns", None, "Opening Song"), (100, 1000)),
    (("Azure Lamps", "", "Closing Song"), (101, 1001)),  # alias of a creator
    (("Blue Lanterns", "", "Farewell"), (101, 1001)),  # alias of an item
    (("!!!", "", "Loud Thing"), (103, 1004)),  # no letters
    (("Many Voices", "Gathering", "Shared Song"), (102, 1002)),  # in the block of the collection's credit
    (("Many Voices", "", "Shared Song"), None),  # but not its own: no canonical collection
    (("Ivanov", "", "Alone"), (NONE_ID, 1005)),  # romanised, stands alone
    (("Nobody At All", "", "Opening Song"), None),
    (("Blue Lanterns", "Unknown Album", "Opening Song"), None),
    (("Blue Lanterns", "???", "Opening Song"), None),  # a collection without letters finds none
    (("", "", "Opening Song"), None),
]


def test_lookup(spark, small):
    asked = spark.createDataFrame([(k, *a) for k, (a, _) in enumerate(CASES)], "req_id long, artist string, release string, recording string")
    got = {r.req_id: (r.release_id, r.recording_id) if r.recording_id is not None else None for r in lookup.lookup(asked, small).collect()}
    assert got == {k: want for k, (_, want) in enumerate(CASES)}


def test_lookup_cleaned(spark, small):
    asked = spark.createDataFrame([(1, "The Blue Lanterns (remastered) feat. X", "", "Opening Song")], "req_id long, artist string, release string, recording string")
    assert lookup.lookup(asked, small, clean=True).first().recording_id == 1000


def test_responses(spark, small):
    asked = spark.createDataFrame([(1, "Blue Lanterns", "", "Opening Song"), (2, "x", "", "y"), (3, None, "", "y")], "req_id long, artist string, release string, recording string")
    got = {r.req_id: r for r in tables.to_response(lookup.lookup(asked, small)).collect()}
    assert [got[k].status for k in (1, 2, 3)] == [200, 404, 400] and '"release_mbid":"rel100"' in got[1].body


def test_index_kinds(spark, small):
    kinds = Counter(r.index_id for r in small.creators.docs.collect())
    assert kinds == {SINGLE: 4, MULTIPLE: 1, SYMBOLS: 1}


def test_tables_round_trip(spark, small, tmp_path):
    tables.save_index(small.blocks, f"{tmp_path}/index")
    assert tables.load_index(spark, f"{tmp_path}/index").docs.count() == small.blocks.docs.count()
    assert tables.has_index(spark, f"{tmp_path}/index") and not tables.has_index(spark, f"{tmp_path}/none")
    columns = [f.name for f in tables.MAPPING]
    tables.write_csv(small.mapping.select(columns), f"{tmp_path}/csv")
    assert sorted(map(str, tables.read_csv(spark, f"{tmp_path}/csv").fillna("").collect())) == sorted(map(str, small.mapping.select(columns).collect()))
    (tmp_path / "bad.csv").write_text(",".join(columns) + "\n1,a,b,c,2,d,3,e,4,f,g,5\nx,a,b,c,2,d,3,e,4,f,g,5\n1,2\n")
    assert tables.read_csv(spark, f"{tmp_path}/bad.csv").collect()[0].score == 5 and len(tables.read_csv(spark, f"{tmp_path}/bad.csv").collect()) == 1
    tables.write_mapping(small.mapping, f"{tmp_path}/mapping")
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_mapping(small.mapping, f"{tmp_path}/mapping")
    old, new = (spark.createDataFrame(x, "k long, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, tables.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert tables.point(old, "k", 2).first().v == "b"
    assert tables.defaults(spark.createDataFrame([(None, None)], "a long, b string")).first() == (0, "")


def test_incremental_blocks_and_stream(spark, small, tmp_path):
    path = f"{tmp_path}/blocks"
    part = small.mapping.filter("artist_credit_id = 10")
    assert serve.extend_blocks(part, path) == 1
    assert serve.extend_blocks(small.mapping, path) == 4
    assert serve.extend_blocks(small.mapping, path) == 0
    stored = tables.load_index(spark, path)
    asked = [(1, "Blue Lanterns", "", "Opening Song"), (2, "x", "", "y")]
    spark.createDataFrame(asked, "req_id long, artist string, release string, recording string").write.parquet(f"{tmp_path}/requests")
    engine = lookup.Engine(small.mapping, small.creators, stored, spark.read.parquet(f"{path}/links"))
    stream = spark.readStream.schema("req_id long, artist string, release string, recording string").parquet(f"{tmp_path}/requests")
    serve.serve(stream, engine, f"{tmp_path}/answers", f"{tmp_path}/state").awaitTermination(120)
    assert sorted(r.status for r in spark.read.json(f"{tmp_path}/answers").collect()) == [200, 404]


def test_mapping_parts(spark, small):
    assert mapping.pending(small.mapping, spark.createDataFrame([(10,)], "index_id long")).count() == 4
    assert dumps.credit_name(small.mapping).count() == 5
    assert {r.release for r in dumps.links_of(small.links, 14).collect()} == {"---"}
    credits = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "artist_credit long, artist long")
    assert dumps.credits_per_artist(credits).first().credits == [1, 2]


def test_env_file(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# c\nA = 1\nB='x y'\n\nC=\"q\"\nbad\n")
    monkeypatch.setenv("A", "2")
    assert read_env_file(tmp_path / ".env") == {"A": "2", "B": "x y", "C": "q"}


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


#: The larger lookups take a minute each; test_lookup has their cases.
@pytest.mark.parametrize("name", sorted(n for n in engine.SQL if not n.startswith("lookup_w") and n != "lookup_json"))
def test_query_against_oracle(spark, oracle, name):
    want = oracle.sql(engine.SQL[name])
    got = engine.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(str, map(tuple, got.select(*want.columns).collect()))) == Counter(map(str, want.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_incremental_blocks_hold_aliases(spark, small, tmp_path):
    path = f"{tmp_path}/blocks"
    aliases = spark.createDataFrame([(1001, "Farewell"), (1004, "Racket")], "recording_id long, name string")
    asked = spark.createDataFrame([(1, "Blue Lanterns", "Second Light", "Farewell"), (2, "!!!", "", "Racket")], "req_id long, artist string, release string, recording string")

    def found():
        engine = lookup.Engine(small.mapping, small.creators, tables.load_index(spark, path), spark.read.parquet(f"{path}/links"))
        return {r.req_id: (r.release_id, r.recording_id) for r in lookup.lookup(asked, engine).collect() if r.recording_id is not None}

    assert serve.extend_blocks(small.mapping.filter("artist_credit_id = 10"), path, aliases) == 1
    assert serve.extend_blocks(small.mapping, path, aliases) == 4
    assert found() == {1: (101, 1001), 2: (103, 1004)}
    serve.extend_blocks(small.mapping, path, aliases.filter("recording_id = 1001"), rebuild=True)
    assert found() == {1: (101, 1001)}


def test_commands(spark, tmp_path):
    """Mapping, indexes and answers from a folder of tables."""
    source, facts, index, out = (f"{tmp_path}/{x}" for x in ("source", "mapping", "index", "answers"))
    for name in ("recording", "release", "artist", "artist_credit", "artist_credit_name", "artist_alias", "recording_alias", "track"):
        engine._rel(spark, SF, name).write.parquet(f"{source}/{name}")
    engine._support(spark, SF).write.parquet(f"{source}/support")
    engine._rel(spark, SF, "requests").limit(3).write.parquet(f"{tmp_path}/requests")
    commands.main(["mapping", "--source", source, "--out", facts], spark)
    commands.main(["indexes", "--source", source, "--mapping", facts, "--out", index], spark)
    commands.main(["lookup", "--requests", f"{tmp_path}/requests", "--mapping", facts, "--index", index, "--out", out], spark)
    assert spark.read.json(out).count() == 3 and spark.read.parquet(facts).count() == engine._mapping(spark, SF).count()
    with pytest.raises(Exception, match="(?i)exists"):
        commands.main(["mapping", "--source", source, "--out", facts], spark)


def test_pairs_are_measured_once_for_each_pair_of_texts(spark):
    calls = spark.sparkContext.accumulator(0)

    def slow(a, b):
        calls.add(1)
        return None if a is None or b is None else distance.script(a, b)

    r = random.Random(6)
    rows = [(k, r.choice([1, 2, None]), r.choice(["ab", "ba", "b", "", None])) for k in range(150)]
    table = spark.createDataFrame(rows, "id long, part int, name string")
    got = pairs.measured_pairs(table, ["part"], "id", "name", lambda a, b: {"n": F.size(F.udf(slow, distance.OPS)(a, b)), "d": distance.edit_distance(a, b), "i": distance.edit_distance(a, b, replace_cost_two=True)})
    got = {(x.a_key, x.b_key): (x.n, x.d) for x in got.collect()}
    want = {}
    for i, p, a in rows:
        for j, q, b in rows:
            if i < j and p is not None and p == q:
                want[i, j] = (None, None) if a is None or b is None else (len(distance.script(a, b)),) * 2
    assert got == want
    assert calls.value <= 2 * 5 * 5


def test_scripts_of_repeated_pairs_are_computed_once(spark):
    counted = spark.sparkContext.accumulator(0)

    def of(a, b):
        counted.add(1)
        return distance.script(a, b)

    rows = spark.createDataFrame([("kitten", "sitting"), ("abc", None)] * 200, "a string, b string").coalesce(1)
    got = rows.select(F.size(distance._each(of, distance.OPS)("a", "b")).alias("n"))
    assert Counter(x.n for x in got.collect()) == {3: 200, None: 200}
    assert counted.value == 1


def test_equal_prefixes_are_compared_once(spark):
    r = random.Random(8)
    docs = [(k, r.choice(["samename", "samenama", "emanemas", "same", "aabbaabb", "bbaabbaa", "x" * 30 + r.choice("yz")])) for k in range(4000)]
    docs += [(4000 + k, "samename") for k in range(1200)]
    asked = ["samename", "samenam", "same", "aabb", "aabbaabb", "nothing"]
    index = fuzzy.build_index(spark.createDataFrame([(0, p, i, t) for p, (i, t) in enumerate(docs)], "index_id long, pos long, entity_id long, text string"))
    assert index.weights.select("index_id", "pos").distinct().count() == 7
    grams = {x.gram: x.df for x in index.vocabulary.collect()}
    assert grams["xxx"] == sum(t[0] == "x" for _, t in docs)
    got = fuzzy.search(spark.createDataFrame([(q, 0, t) for q, t in enumerate(asked)], "q long, index_id long, text string"), index).collect()
    for q, t in enumerate(asked):
        assert [(x.pos, x.confidence) for x in sorted(got, key=lambda x: x.rank) if x.q == q] == plain_search(docs, t)
    assert sum(x.q == 0 for x in got) == 1000
    # an index with weights at every position finds the same
    every = fuzzy.Index(index.docs, *tfidf.build(index.docs))
    again = fuzzy.search(spark.createDataFrame([(0, 0, "samename")], "q long, index_id long, text string"), every).collect()
    assert {(x.pos, x.confidence) for x in again} == {(x.pos, x.confidence) for x in got if x.q == 0}


def test_a_pair_is_one_row_of_a_shuffle(spark):
    def written() -> int:
        jvm = spark._jvm
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    r = random.Random(9)
    docs = [(k, "same" + "".join(r.choices("abcdefghijklmnop", k=26))) for k in range(1500)]
    asked = [f"{x}same" for x in "qrstuvwxyz"] + ["same", docs[7][1]]
    built = fuzzy.build_index(spark.createDataFrame([(0, p, i, t) for p, (i, t) in enumerate(docs)], "index_id long, pos long, entity_id long, text string"))
    index = fuzzy.Index(built.docs, built.vocabulary.cache(), built.weights.cache())
    queries = spark.createDataFrame([(0, t) for t in asked], "index_id long, query string")
    rows = index.weights.count() + index.vocabulary.count()
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = fuzzy._cosine(queries, index, fuzzy.THRESHOLD).collect()
        made = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert len(got) >= 11 * len(docs)
    assert made <= 2 * rows + 6 * len(got)  # with a row for each of a pair's 28 terms over 28 * len(got)
    assert [(x.pos, x.confidence) for x in got if x.query == docs[7][1] and x.confidence >= 0.7] == plain_search(docs, docs[7][1])


def test_blocks_are_built_for_the_creators_reached(spark):
    asked = engine._rel(spark, SF, "requests").limit(12)
    asked = asked.unionByName(asked.withColumn("req_id", -F.col("req_id") - 1)).cache()
    sources, built = engine._sources(spark, SF), engine._engine(spark, SF)
    creators = lookup.creator_hits(asked, sources.creators).cache()
    reached = sources.reached(creators)
    blocks = {x.index_id // 2 for x in reached.blocks.docs.select("index_id").distinct().collect()}
    assert blocks and blocks <= {x.creator for x in creators.collect()}
    # a collection's own block has the rows of other credits too
    own = sources.reached(spark.createDataFrame([(1000005,)], "creator long"))
    want = built.blocks.docs.filter("index_id in (2000010, 2000011)")
    assert want.count() and sorted(map(tuple, own.blocks.docs.collect())) == sorted(map(tuple, want.collect()))
    key = lambda x: x["req_id"]
    got = sorted(lookup.lookup(asked, sources).collect(), key=key)
    assert got == sorted(lookup.lookup(asked, built).collect(), key=key) and len(got) == 24
    assert any(x.recording_id is not None for x in got)
    answers = {x.req_id: tuple(x)[1:] for x in got}
    assert all(answers[-r - 1] == a for r, a in answers.items() if r >= 0)


def test_reach_goes_below_joins(spark):
    left = spark.range(1000).selectExpr("id AS a", "id * 7 AS b")
    rows = left.join(spark.range(7000).selectExpr("id AS b", "concat('x-', id) AS name"), "b").select("a", "name")
    for ids, key in ((spark.range(0, 1000, 100).selectExpr("id AS a"), "a"), (spark.range(0, 7000, 700).selectExpr("concat('x-', id) AS name"), "name")):
        some = rows.filter(lookup.reach(ids, F.col(key)))
        plan = some._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join Inner") < plan.index("getbit")  # as the scans' filter, not above the join
        assert sorted(some.join(ids, key, "left_semi").collect()) == sorted(rows.join(ids, key, "left_semi").collect()) and some.count() < 30
    assert rows.filter(lookup.reach(ids.limit(0), F.col("name"))).count() == 0


def test_stored_steps_release_their_shuffle_files(spark):
    def files() -> int:
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("/shuffle_")

    scratch.release(spark)
    time.sleep(2)
    before = files()
    for _ in range(5):
        lookup.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "step")
    one = 3 * 4  # data, index and checksum of each task of one step, which may stay until the next
    for _ in range(20):
        if files() <= before + one:
            break
        time.sleep(0.5)
    assert files() <= before + one


def test_documents_are_weighed_in_the_search(spark):
    r = random.Random(12)
    step = cosine.PART - 3  # positions of several parts
    docs = [(k * step, "".join(r.choices("abcé", k=r.choice([0, 2, 5, 9, 40])))) for k in range(90)] + [(7, None)]
    rows = [(i, p, p, t) for i in (3, 4) for p, t in docs] + [(5, p, p, t) for p, (_, t) in enumerate(docs)]
    frame = spark.createDataFrame(rows, "index_id long, pos long, entity_id long, text string")
    asked = [t for _, t in docs[:40]] + ["abcéabc", "zzz", None]
    queries = spark.createDataFrame([(q, i, t) for q, t in enumerate(asked) for i in (3, 5, 6)], "q long, index_id long, text string")
    key = lambda x: (x["q"], x["index_id"], x["rank"])
    got = sorted(fuzzy.search(queries, fuzzy.Index(frame)).collect(), key=key)
    assert got == sorted(fuzzy.search(queries, fuzzy.build_index(frame)).collect(), key=key)
    assert {x.index_id for x in got} == {3, 5}


def test_no_gram_or_pair_is_shuffled(spark):
    """A search writes texts to its shuffles, neither their grams nor candidates."""
    docs = [(0, k, k, f"same{k:06}name") for k in range(3000)]
    index = fuzzy.Index(spark.createDataFrame(docs, "index_id long, pos long, entity_id long, text string"))
    queries = spark.createDataFrame([(0, f"same{k:06}nam") for k in range(0, 3000, 10)], "index_id long, query string")
    found = fuzzy._cosine(queries, index, fuzzy.THRESHOLD, least=fuzzy.THRESHOLD)
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "MapInArrow" in plan
    assert {(x.query, x.pos) for x in rows} >= {(f"same{k:06}nam", k) for k in range(0, 3000, 10)}
    assert len(rows) < 300 * 3000 / 4


def test_large_sides_are_filtered_before_the_mapping_joins(spark, tmp_path):
    spark.range(2000).selectExpr("id AS o", "id % 50 AS c").write.parquet(f"{tmp_path}/orders")
    spark.range(40000).selectExpr("id % 2000 AS o", "id AS item").write.parquet(f"{tmp_path}/items")
    rows = lambda: spark.read.parquet(f"{tmp_path}/items").join(spark.read.parquet(f"{tmp_path}/orders").filter("c = 7"), "o")
    names = list(lookup.RUNTIME_FILTERS)
    before = [spark.conf.get(n) for n in names]
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with lookup.runtime_filters(spark):
            some = rows()
            assert "might_contain" in some._jdf.queryExecution().optimizedPlan().toString()
            got = sorted(some.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert [spark.conf.get(n) for n in names] == before
    assert len(got) == 800 and got == sorted(rows().collect())
