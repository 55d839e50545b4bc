from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from sievework import session
from sievework.functions import scalars as s
from sievework.operators import dedup, facets, joining, monitor, rules, vectors
from sievework.plans import pipelines
from sievework.sources import readers, sinks


def same_issue(a, b, jaccard, overlap, least):
    shared = len(a & b)
    return bool(a and b) and (shared >= jaccard * len(a | b) or (shared >= least and shared >= overlap * min(len(a), len(b))))


@pytest.mark.parametrize("local", [100_000, 2])
def test_same_issue_leaders_against_a_scan(spark, monkeypatch, local):
    """Random token sets, ties and copies: pairs and greedy leaders equal brute force, whether decided locally or by rounds."""
    monkeypatch.setattr(dedup, "LOCAL", local)
    rng = random.Random(5)
    sets = [sorted(rng.sample("abcdefghijkl", rng.randrange(0, 8))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, sig array<string>")
    want = {(i, j) for j in range(60) for i in range(j) if same_issue(set(sets[i]), set(sets[j]), 0.6, 0.67, 4)}
    got = {(r["lo"], r["hi"]) for r in dedup.same_issue_pairs(df, "id", "sig", 0.6, 0.67, 4).collect()}
    assert got == want and any(len(set(sets[i]) & set(sets[j])) < 0.6 * len(set(sets[i]) | set(sets[j])) for i, j in want)
    leaders, own = [], {}
    for i, x in enumerate(sets):
        own[i] = next((k for k in leaders if same_issue(set(x), set(sets[k]), 0.6, 0.67, 4)), i)
        if own[i] == i:
            leaders.append(i)
    assert {r["id"]: r["leader"] for r in dedup.token_leaders(df, "id", "sig", 0.6, 0.67, 4).collect()} == own
    assert dedup.token_leaders(df.where("id < 0"), "id", "sig", 0.6, 0.67).collect() == []


def test_rounds_that_run_out_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(20)], "lo long, hi long")
    nodes = spark.range(21)
    with pytest.raises(RuntimeError):
        dedup.components(nodes, path, rounds=2)
    rows = spark.createDataFrame([(i, f"k{i}", f"k{i + 1}") for i in range(20)], "o long, a string, b string")
    crossed = rows.select("o", "a", F.col("b").alias("c")).unionByName(rows.select((F.col("o") + 100).alias("o"), F.col("b").alias("a"), F.col("a").alias("c")))
    with pytest.raises(RuntimeError):
        dedup.greedy_keys(crossed, ["a", "c"], "o", rounds=0)


def test_refine_keeps_dupes_in_order(spark):
    rows = [(1, "x", ["a", "b"], [[9, "t9"]]), (2, "x", ["a", "c"], None), (3, "x", ["c", "d"], [[8, "t8"]]), (4, "y", ["a"], None), (5, "x", [], None), (6, "x", ["a"], None)]
    df = spark.createDataFrame([(i, c, g, f"t{i}", [tuple(x) for x in d] if d else None) for i, c, g, d in rows], "id long, cat string, sig array<string>, title string, dupes array<struct<id:long,title:string>>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.2]), (4, [1.0, 0.0]), (5, [1.0, 0.0])], "id long, v array<double>")
    got = {r["id"]: [d["id"] for d in r["dupes"]] if r["dupes"] else None for r in vectors.refine(df, "id", "cat", "sig", v, "v", 0.9, 1, ["title"]).collect()}
    assert got == {1: [9, 2, 3, 8], 4: None, 5: None, 6: None}
    bare = vectors.refine(df.drop("dupes"), "id", "cat", "sig", v, "v", 0.9, 1, ["title"])
    assert {r["id"]: [d["id"] for d in r["dupes"]] if r["dupes"] else None for r in bare.collect()}[1] == [2, 3]


def test_similarities_in_pieces(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(99, None)], "id long, v array<double>")
    protos = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "label int, prototype array<double>")
    one = sorted(map(tuple, vectors.similarities(v, "id", "v", protos).collect()))
    assert sorted(map(tuple, vectors.similarities(v, "id", "v", protos, limit_bytes=20).collect())) == one and len(one) == 45
    kept = {r["id"]: r["label"] for r in vectors.gate(vectors.similarities(v, "id", "v", protos), "id", 0.999, v).collect()}
    assert kept[99] is None and kept[0] == 0 and len(kept) == 10


def test_lookup_of_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 50}" if i % 3 == 1 else None) for i in range(30_000 * 2)], "i long, k string")
    one = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("low"))
    got = joining.lookup(rows, one, "k", ["low"], "n", most=16)
    want = rows.join(one.select("k", "low"), "k").select("i", "k", "low")
    assert got.count() == 40_000 and got.exceptAll(want).count() == 0
    assert joining.lookup(rows, one.where("k = 'none'"), "k", ["low"], "n").collect() == []


def test_nearest_rank_of_groups_over_many_tasks(spark):
    import math

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b"]), float(rng.randrange(40))) for _ in range(500)] + [("c", 1.0), ("d", None)]
    got = {r["g"]: (r["p5"], r["p50"], r["p95"]) for r in facets.nearest_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [5, 50, 95]).collect()}
    for g in "abc":
        own = sorted(v for k, v in rows if k == g)
        half_even = lambda x: math.floor(x + 0.5) if x % 1 != 0.5 else round(x)
        assert got[g] == tuple(own[half_even(p / 100 * (len(own) - 1))] for p in (5, 50, 95))
    assert "d" not in got


def test_messages_and_titles(spark):
    df = spark.createDataFrame([("T", None, "", "body"), ("", "Firm", "2027-01-01", None)], "title string, company string, deadline string, excerpt string")
    got = [r[0] for r in df.select(s.message("{title}|{company}|{deadline}", {"title": "", "company": "-", "deadline": "always"}, F.col("excerpt"), "--")).collect()]
    assert got == ["T|-|always\n--\nbody", "|Firm|2027-01-01"]
    p = df.select(s.payload("{title}", "{deadline}", {"title": "x" * 200, "deadline": "always"}, F.lit(None).cast("string")).alias("p")).select("p.*").collect()
    assert (p[0]["title"], p[0]["tag"], len(p[1]["title"]), p[1]["tag"]) == ("T", "T", 120, "x" * 200)
    titles = [("[Acme Co] Clerk", "Acme Co"), ("Acme Co - Clerk", "Acme Co"), ("AcmeCo: Clerk", "Acme"), ("Acme", "Acme"), ("[Other] Clerk", "Acme"), ("Clerk", None), ("", "Acme")]
    shown = [r[0] for r in spark.createDataFrame(titles, "t string, c string").select(s.display_title(F.col("t"), F.col("c"))).collect()]
    assert shown == ["Clerk", "Clerk", "Co: Clerk", "Acme", "[Other] Clerk", "Clerk", ""]
    wide = spark.createDataFrame([("２０２７．１．２",), ("2027-02-30 2027-03-01",)], "t string")
    assert [r[0] for r in wide.select(s.iso_date(F.translate("t", "．", "."))).collect()] == ["2027-01-02", ""]


def test_article_gate_rules(spark):
    gate = rules.ArticleRules(sources=["Blog"], noise=["prize"], topics=["tax"], endings=["city"], actions=["seminar"], least=5, pairs=[(["subsidy"], ["skills"])], kept=["court"], always=[(["opens"], ["office"])], scoped={"deal": ["estate"]}, abroad=["deal"], abroad_sources=["wire"], abroad_names=["france"], home=["korea"])
    cases = [
        ("tax law", "Daily", "x", True), ("tax law", "My Blog", "x", False), ("tax prize", None, "x", False), ("law", "Daily", "x", False),
        ("tax seminar of bigcity", "Daily", "x", False), ("tax seminar of bigcity, court", "Daily", "x", True), ("tax seminar of city", "Daily", "x", True),
        ("tax subsidy skills", "Daily", "x", False), ("tax opens office, court", "Daily", "x", False), ("tax estate", "Daily", "deal", False), ("tax estate", "Daily", "x", True),
        ("tax korea", "The Wire", "deal", False), ("tax France", "Daily", "deal", False), ("tax France Korea", "Daily", "deal", True), ("tax France", "Daily", None, True),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t string, s string, c string")
    got = {r["i"] for r in df.where(rules.article_gate(F.col("t"), F.col("s"), F.col("c"), gate)).collect()}
    assert got == {i for i, c in enumerate(cases) if c[3]}
    assert df.where(rules.article_gate(F.col("t"), F.col("s"), F.col("c"), rules.ArticleRules())).count() == len(cases)


def test_fallback_label_and_leaks(spark):
    df = spark.createDataFrame([("a", "bank"), ("b", "bank"), (None, "village"), ("c", "none")], "s string, t string")
    own = rules.fallback_label(F.col("s"), F.col("t"), {"a": "A", "b": "local"}, {"bank": ["bank"]}, "local", ["village"], "other")
    assert [r[0] for r in df.select(own).collect()] == ["A", "bank", "local", "other"]
    assert monitor.leaks(df, F.col("t"), F.col("s"), ["bank", "village"], ["a"]).first()["leaked"] == 2


def test_versions_survive_a_broken_writer(spark, tmp_path):
    v = sinks.Versioned(spark, f"{tmp_path}/state", keep=2)
    assert v.read("a long").collect() == [] and v.versions() == []
    for i in range(4):
        assert v.write(spark.createDataFrame([(i,)], "a long"))
    assert v.versions() == [4, 3] and v.read("a long").first()["a"] == 3
    spark.createDataFrame([(9,)], "a long").write.parquet(f"{tmp_path}/state/v-5")  # a writer that broke off before its marker
    assert v.read("a long").first()["a"] == 3
    assert not v.write(spark.createDataFrame([], "a long")) and v.read("a long").first()["a"] == 3
    assert v.write(spark.createDataFrame([(6,)], "a long")) and v.versions()[0] == 6
    for f in (tmp_path / "state" / "v-6").glob("*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "state" / "v-6").glob(".*.crc"):
        f.unlink()
    assert v.read("a long").first()["a"] == 3


def test_feed_document():
    first = sinks.feed(None, "t1", new_items=[1])
    assert sinks.json.loads(first) == {"digest": None, "generated_at": "t1", "new_items": [1]}
    second = sinks.json.loads(sinks.feed(first, "t2", digest="d"))
    assert second == {"digest": "d", "generated_at": "t2", "new_items": [1]}
    assert sinks.json.loads(sinks.feed("{broken", "t3"))["new_items"] == []


def test_list_pages_by_script_calls(spark):
    html = """<table><tr><th>no</th></tr><tr><td class=txt>Firm A</td><td><a href="#" onclick="goView('123','x')"> A  job </a></td><td>2027.1.2</td></tr>
    <tr><td>Firm B</td><td><a onclick="other(5)">B</a></td></tr></table>"""
    pages = spark.createDataFrame([("s", 1, html), ("s", 2, None)], "source string, page int, html string")
    got = readers.call_rows(pages, "html", "page", "goView").withColumn("posted", s.iso_date(F.col("line"))).collect()
    assert [(r["native_id"], r["title"], r["cells"][0], r["posted"]) for r in got] == [("123", "A job", "Firm A", "2027-01-02")]
    posted, deadline = readers.first_and_last_date(F.col("t"))
    dates = spark.createDataFrame([("2027-01-01 ~ 2027-02-01",), ("2027-01-05",), ("none",)], "t string").select(posted.alias("p"), deadline.alias("d"))
    assert list(map(tuple, dates.collect())) == [("2027-01-01", "2027-02-01"), ("2027-01-05", "2027-01-05"), ("", "")]
    cells = spark.createDataFrame([([["Deadline", "2027-01-01", "Place", "Seoul"], ["Other", "x"]],), ([],)], "c array<array<string>>")
    assert [r[0] for r in cells.select(readers.labelled_values(F.col("c"), ["Deadline", "Place"])).collect()] == [{"Deadline": "2027-01-01", "Place": "Seoul"}, {}]


def test_api_pages_stop_at_the_last(spark):
    from pyspark.sql import types as T

    body = '{"list":[{"id":%s}],"pagination":{"totalPages":%s}}'
    pages = spark.createDataFrame([("s", 1, body % ('"1"', 2)), ("s", 2, body % ("null", 2)), ("s", 3, body % ('"3"', 2)), ("t", 1, '{"list":[{"id":"9"}]}'), ("t", 2, body % ('"8"', 1))], "source string, page int, body string")
    item = T.StructType([T.StructField("id", T.StringType())])
    got = readers.api_pages(pages, "body", item, "list", total="$.pagination.totalPages", require="id").collect()
    assert sorted((r["source"], r["id"]) for r in got) == [("s", "1"), ("t", "9")]


def test_registry_pools_and_cursor(spark):
    pools = readers.feed_pools(spark, {"a": "q", "b": ["r", "s"]}, "f_", 5).orderBy("source_ord").collect()
    assert [(r["source"], r["pool"]) for r in pools] == [("f_a", 0), ("f_b", 0), ("f_b_2", 1)]
    known = readers.registry(spark, [{"source": "z", "pattern": "x"}, {"source": "a", "skip": ["y"]}]).orderBy("source_ord").collect()
    assert [r["source"] for r in known] == ["z", "a"] and "skip" in known[1]["descriptor"]
    rows = [(1, "c1", ["sub:1", "x:1"], ["a", "b"], False), (2, None, ["sub:2", "sub:1"], ["c", "d"], True), (3, None, ["sub:9"], ["z"], True)]
    got = readers.keyed_values(spark.createDataFrame(rows, "page int, cursor string, keys array<string>, values array<string>, complete boolean"), "sub:").collect()
    assert {r["key"]: r["value"] for r in got} == {"sub:1": "d", "sub:2": "c"}


def test_subscribers_of_either_form(spark, tmp_path):
    one = '{"endpoint":"https://a","p256dh":"k","auth":"x","scope":"all"}'
    for name, body in (("bare", f"[{one}]"), ("wrapped", '{"subscriptions":[%s,{"endpoint":""}]}' % one)):
        (tmp_path / name).write_text(body)
        assert [r["endpoint"] for r in readers.subscriptions(spark, str(tmp_path / name)).collect()] == ["https://a"]
    assert readers.subscriptions(spark, str(tmp_path / "none")).collect() == []


def test_posted_sort_falls_back_to_first_seen(spark):
    rows = [(1, "2027-01-02", "2027-01-02T01:00:00"), (2, "", "2027-01-03T01:00:00"), (3, None, None), (4, "2027-01-02", "2027-01-02T02:00:00")]
    jobs = spark.createDataFrame([(*r, "t", "c", "open", 3, True) for r in rows], "id long, posted_date string, first_seen string, title string, company string, status string, dday int, is_new boolean")
    assert [r["id"] for r in pipelines.jobs_query(jobs, "id", sort="posted").collect()] == [2, 4, 1, 3]
    assert pipelines.jobs_query(jobs.withColumn("category", F.lit("word")), "id", keyword="word").collect() == []


def test_cluster_without_shared_folder_raises():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def shuffled_rows(spark, after=-1):
    """Rows written to shuffles by the stages after a stage, and the last stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    lists, none = sc._jvm.java.util.ArrayList, sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(lists(), False, False, none, lists())
    each = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in each if s.stageId() > after), max([after, *(s.stageId() for s in each)])


def slots(rng, n):
    """Titles of few words, each from a short list of its own: no word is rare."""
    return [sorted({f"{i}-{rng.randrange(k)}" for i, k in enumerate((40, 12, 10, 6, 4, 4, 3)[: rng.choice((5, 6, 7, 7))])}) for _ in range(n)]


def test_pairs_of_titles_without_rare_words(spark):
    """Near titles whose words are all frequent are found, and only sets and pairs that are near are shuffled, not all that share a word."""
    sets = [list(x) for x in sorted({tuple(x) for x in slots(random.Random(8), 2000)})]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, sig array<string>").repartition(4).cache()
    df.count()
    of = [set(x) for x in sets]
    want = {(i, j) for j in range(len(of)) for i in range(j) if len(of[i] & of[j]) >= 0.8 * len(of[i] | of[j])}
    before = shuffled_rows(spark)[1]
    got = dedup.prefix_pairs(df, "id", "sig", 0.8).collect()
    assert len(got) == len(want) and {(r["lo"], r["hi"]) for r in got} == want and want
    assert all(r["shared"] == len(of[r["lo"]] & of[r["hi"]]) for r in got)
    assert shuffled_rows(spark, before)[0] < 60 * len(sets)


@pytest.mark.parametrize("most", [512, 6])
def test_same_issue_without_rare_words(spark, monkeypatch, most):
    """Pairs by the share of the shorter title, among them titles of one to sixty words and keys of different lengths."""
    monkeypatch.setattr(dedup, "MOST_KEYS", most)
    rng = random.Random(9)
    some = slots(rng, 1500)
    some += [sorted({*x, *(f"{i}-{rng.randrange(4)}" for i in range(4, 60))}) for x in some[:5]] + [x[:k] for x in some[:20] for k in (1, 2, 3, 4)]
    sets = [set(x) for x in sorted({tuple(x) for x in some})]
    df = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id long, sig array<string>").repartition(4).cache()
    df.count()
    want = {(i, j) for j in range(len(sets)) for i in range(j) if same_issue(sets[i], sets[j], 0.8, 0.8, 4)}
    before = shuffled_rows(spark)[1]
    got = dedup.same_issue_pairs(df, "id", "sig", 0.8, 0.8, 4).collect()
    assert len(got) == len(want) and {(r["lo"], r["hi"]) for r in got} == want
    assert {(r["lo"], r["hi"]) for r in dedup.overlap_pairs(df, "id", "sig", 0.8, 4).collect()} == {(i, j) for i, j in want if (n := len(sets[i] & sets[j])) >= 4 and n >= 0.8 * min(len(sets[i]), len(sets[j]))}
    if most > 6:
        assert shuffled_rows(spark, before)[0] < 150 * len(sets)


def test_leaders_of_titles_without_rare_words(spark):
    """Greedy leaders of titles whose words are all frequent, without shuffling all pairs that share a word."""
    sets = [set(x) for x in slots(random.Random(10), 2000)]
    df = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id long, sig array<string>").repartition(4).cache()
    df.count()
    leaders, own = [], {}
    for i, x in enumerate(sets):
        own[i] = next((k for k in leaders if same_issue(x, sets[k], 0.8, 0.8, 4)), i)
        if own[i] == i:
            leaders.append(i)
    before = shuffled_rows(spark)[1]
    assert {r["id"]: r["leader"] for r in dedup.token_leaders(df, "id", "sig", 0.8, 0.8, 4).collect()} == own
    assert shuffled_rows(spark, before)[0] < 100 * len(sets)


def test_refine_compares_only_rows_with_vectors(spark):
    """Rows without a vector are never merged, so they don't meet anything: 3,000 alike rows of which three have one."""
    df = spark.range(3000).select("id", F.lit("x").alias("cat"), F.array(F.lit("a"), F.lit("b"), F.concat(F.lit("c"), F.col("id") % 7)).alias("sig")).repartition(4).cache()
    df.count()
    v = spark.createDataFrame([(4, [1.0, 0.0]), (9, [1.0, 0.1]), (12, [0.0, 1.0]), (9000, [1.0, 0.0])], "id long, v array<double>")
    before = shuffled_rows(spark)[1]
    got = {r["id"]: [d["id"] for d in r["dupes"]] for r in vectors.refine(df, "id", "cat", "sig", v, "v", 0.9, 2, ["cat"]).where("dupes is not null").collect()}
    assert got == {4: [9]}
    assert shuffled_rows(spark, before)[0] < 30 * 3000


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.mark.parametrize("local", [8_000_000, 2])
def test_leaders_in_slices_leave_nothing_on_disk(spark, monkeypatch, local):
    """Pairs joined in slices of the keys give the leaders of a scan; tables of the steps are gone after them."""
    monkeypatch.setattr(dedup, "LOCAL", local)
    monkeypatch.setattr(dedup, "SLICE", 0)
    rng = random.Random(8)
    sets = [sorted(set(rng.choices("abcdefghij", k=rng.randrange(0, 9)))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, sig array<string>")
    leaders, own = [], {}
    for i, x in enumerate(sets):
        own[i] = next((k for k in leaders if same_issue(set(x), set(sets[k]), 0.6, 0.67, 4)), i)
        if own[i] == i:
            leaders.append(i)
    paths = set(session._PATHS)
    led = dedup.token_leaders(df, "id", "sig", 0.6, 0.67, 4)
    kept = {p.rsplit("/", 1)[1].split("-")[0] for p in session._PATHS if p not in paths}
    assert kept <= {"signed", "reps", "sets", "met", "decided"} | ({"leaders"} if local == 2 else set())
    assert {r["id"]: r["leader"] for r in led.collect()} == own


def test_written_leaves_no_shuffle_files(spark):
    spark._jvm.System.gc()
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    out = session.written(counts, "counts")
    for _ in range(50):  # they are deleted in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert {(r["k"], r["n"]) for r in out.collect()} == {(k, 143 if k < 6 else 142) for k in range(7)}
    assert counts.count() == 7 and spark.conf.get(session.CLEANUP) == "false"


def test_greedy_keys_keep_only_what_is_kept_on_disk(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["", *"abcdefgh"]), rng.choice(["", *"klmnopqrstuv"])) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, url string, title string")
    seen, want = (set(), set()), set()
    for i, u, t in rows:
        if not (u and u in seen[0] or t and t in seen[1]):
            want.add(i)
            seen[0].add(u), seen[1].add(t)
    paths = set(session._PATHS)
    kept = dedup.greedy_keys(df, ["url", "title"], "id")
    left = [p for p in session._PATHS if p not in paths]
    assert {r["id"] for r in kept.collect()} == want
    assert sum(spark.read.parquet(p).count() for p in left) == len(want)
