import hashlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from smoothspan.llm import containment, quote_links, registry, temporal_lists
from smoothspan.llm.bytescan import text_buffers
from smoothspan.llm.components import connected_components
from smoothspan.llm.containment import contained_items, drop_contaminated
from smoothspan.llm.line_join import LineSettings, _line_sets, count_classes, drop_duplicate_lines, duplicate_lines, line_report
from smoothspan.llm.paragraph_iblt import IbltSettings, next_ids, recovered_differences, version_fingerprints
from smoothspan.llm.quote_links import link_conversations
from smoothspan.llm.super_minhash import MinHashSettings, keep_one_of_each, near_duplicates
from smoothspan.llm.temporal_lists import temporal_join

from . import brute


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").persist()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]


def varied(seed, n, words=60, changed=3):
    """n versions of one text, each with some words changed."""
    import random

    r = random.Random(seed)
    base = [f"w{r.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in r.sample(range(words), r.randint(0, changed)):
            w[k] = f"x{r.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# Near duplicates.


def check_near(df, pairs):
    sets = {i: brute.shingles(t) for i, t in pairs}
    want = brute.components(sets)
    got = {r["node"]: (r["component_id"], r["n_shingles"]) for r in near_duplicates(df).collect()}
    assert got == {i: (want[i], len(sets[i])) for i in sets}


def test_near_duplicates_of_documents(docs, texts):
    check_near(docs, texts)


def test_near_duplicates_in_groups(spark):
    """Groups whose members are near some and not others, so that mixed buckets are compared block by block."""
    rows = [t for seed in range(3) for t in varied(seed, 60, 60, 4)] + varied(9, 30, 200, 30)
    pairs = list(enumerate(rows))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    check_near(df, pairs)
    small = near_duplicates(df, MinHashSettings(block_items=500, broadcast_rows=0)).groupBy("component_id").count().count()
    assert small == len(set(brute.components({i: brute.shingles(t) for i, t in pairs}).values()))


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near_duplicates(odd).toPandas()
    assert len(got) == odd.count()
    by = got.dropna(subset=["node"]).drop_duplicates("node").set_index("node")["component_id"]
    assert by[1] == 0 and by[2] == 0 and by[4] == 4 and by[5] == 5 and by[9] == 8 and by[8] == 8
    assert got[got["node"].isna()]["component_id"].isna().all()
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns and 1 not in {r["doc_id"] for r in kept.collect()}
    assert kept.where("doc_id is null").count() == 2
    assert near_duplicates(empty).count() == 0


# Lines.


@pytest.mark.parametrize("settings", [LineSettings(), LineSettings(short_list=1, block_items=300, broadcast_rows=0)])
def test_lines_of_documents(docs, texts, settings):
    got = {(r["doc"], r["line"]) for r in duplicate_lines(docs, settings).collect()}
    assert got == brute.duplicate_lines(texts)


def test_short_lines_of_the_query(spark, sf_dir, texts):
    gone, seen = brute.duplicate_lines(texts), set()
    for i, text in texts:
        for n, line in enumerate((text or "").split("\n")):
            w = tuple(brute.words(line))
            if 0 < len(w) < 5:
                if w in seen:
                    gone.add((i, n))
                seen.add(w)
    got = {r["doc_id"]: r["text"] for r in registry.op3_line_join(spark, sf_dir).collect()}
    assert got == {i: brute.without(t, {n for d, n in gone if d == i}) for i, t in texts}
    df = spark.createDataFrame([(1, "Home\nA b\n\nhome"), (2, "a  B\nb a\n\na b c d\na b c d e"), (3, "a b c d\nA b c d e")], "doc_id long, text string")
    got = {(r["doc"], r["line"]) for r in duplicate_lines(df, LineSettings(short_lines=True)).collect()}
    assert got == {(1, 3), (2, 0), (3, 0), (3, 1)}


def test_lines_of_near_copies(spark):
    rows = list(enumerate(varied(4, 150, 40, 4)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc"], r["line"]) for r in duplicate_lines(df).collect()}
    assert got == brute.duplicate_lines(rows)


def test_token_classes_follow_counts(spark, texts):
    """Classes come from the counts over all documents; the few that collisions change are more common ones."""
    texts = texts + [(10_000 + i, texts[i % 7][1]) for i in range(1500)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)

    def tokens(values):
        raw, offsets = text_buffers(pa.array(values, pa.string()))
        return _line_sets(raw, offsets, 5, False)[1]

    token, count = np.unique(np.concatenate([tokens([t or ""]) for _, t in texts]), return_counts=True)
    for settings in (LineSettings(), LineSettings(run_tokens=500)):
        got = count_classes(docs, settings).of(token)
        want = np.select([count >= 2 * 4**k for k in range(8, -1, -1)], range(9, 0, -1), 0)
        assert (got >= want).all() and (got != want).mean() < 1e-3 and set(want) >= {0, 1, 4}


def test_lines_of_odd_rows(odd, empty):
    out = drop_duplicate_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    by = {r["doc_id"]: r["text"] for r in out.where("doc_id is not null").collect()}
    assert by[0] == "" and by[3].startswith("an entirely") and "\n" not in by[3] and by[5] is None and by[4] == "" and by[8] == "short one"
    null = {r["text"] for r in out.where("doc_id is null").collect()}
    assert None in null and len(null) == 2  # the first line of the order is the one with a null id
    assert line_report(odd).count() == odd.count() and drop_duplicate_lines(empty).count() == 0


# Containment.


def test_containment(spark, sf_dir, texts, docs, odd, empty):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    got = {(r["doc_id"], r["item_id"]) for r in contained_items(docs, items).collect()}
    assert got == brute.contained(texts, pairs) and got
    few = containment.ContainmentSettings(broadcast_rows=0)
    assert {(r["doc_id"], r["item_id"]) for r in contained_items(docs, items, few).collect()} == got
    kept = {r["doc_id"] for r in drop_contaminated(docs, items).collect()}
    assert kept == {i for i, _ in texts} - {d for d, _ in got}
    mine = spark.createDataFrame([(1, "fox jumps over the lazy dog near the"), (2, None), (3, ""), (4, "short ONE"), (None, "an entirely different passage of text with"), (1, "nothing of this is anywhere at all")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in contained_items(odd, mine).collect()}
    assert found == {(0, 1), (1, 1), (2, 1), (3, 1), (None, 1), (8, 4), (9, 4), (3, None)}
    assert drop_contaminated(odd, mine).columns == odd.columns
    assert contained_items(empty, mine).count() == 0 and contained_items(odd, mine.limit(0)).count() == 0


def test_size_partitions_have_their_own_thresholds(spark):
    """Items of very different sizes, some in documents, of which a quarter of the words may differ."""
    import random

    r = random.Random(8)
    items = [(k, " ".join(f"i{k}w{n}" for n in range(size))) for k, size in enumerate([5, 6, 9, 12, 20, 33, 64, 200, 700])]
    docs = []
    for k, text in items:
        w = text.split()
        for copy in range(4):
            kept = [x if r.random() > 0.04 * copy else f"o{r.random()}" for x in w]
            docs.append((len(docs), " ".join([*(f"b{r.random()}" for _ in range(50)), *kept, *(f"e{r.random()}" for _ in range(400))])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    for settings in (containment.ContainmentSettings(), containment.ContainmentSettings(broadcast_rows=0)):
        got = {(r["doc_id"], r["item_id"]) for r in contained_items(d, i, settings).collect()}
        assert got == brute.contained(docs, items) and len({x for _, x in got}) == len(items)


# Fingerprints.


def pieces(text, k=IbltSettings().piece_words):
    out = set()
    for line in (text or "").split("\n"):
        if line.strip(" "):
            w = line.split(" ")
            out |= {tuple(w[i : i + k]) for i in range(0, len(w), k)}
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def parsed(fingerprint):
    n, width, cells = fingerprint.split(";")
    out = {}
    for x in filter(None, cells.split(",")):
        i, c, k, h = x.split(":")
        out[int(i)] = (int(c), int(k, 16), int(h, 16))
    return int(n), int(width), out


def likeness_of(a, b):
    """Likeness from two fingerprint strings alone, by folding, subtracting and peeling; None if cells stay."""
    (n, wa, ca), (_, wb, cb) = parsed(a), parsed(b)
    w = min(wa, wb)
    cells = {}
    for sign, table in ((1, ca), (-1, cb)):
        for i, (c, k, h) in table.items():
            i = (i // 3 & (w - 1)) * 3 + i % 3
            x = cells.get(i, (0, 0, 0))
            cells[i] = (x[0] + sign * c, x[1] ^ k, x[2] ^ h)
    only = {1: 0, -1: 0}
    todo = list(cells)
    while todo:
        c, k, h = cells[todo.pop()]
        if abs(c) != 1 or h != xxhash.xxh64_intdigest(bytes(4), xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42)):
            continue
        places = [(h >> 20 * p & (w - 1)) * 3 + p for p in range(3)]
        only[c] += 1
        for i in places:
            x = cells.get(i, (0, 0, 0))
            cells[i] = (x[0] - c, x[1] ^ k, x[2] ^ h)
        todo += places
    if any(x != (0, 0, 0) for x in cells.values()):
        return None
    return (n - only[1]) / (n + only[-1]) if n + only[-1] else 1.0


def check_fingerprints(part, got):
    """All columns of the query against plain Python; likeness without retries also from the fingerprint strings alone."""
    by, peeled = {}, 0
    for k, (i, text) in enumerate(part):
        after = part[(k + 1) % len(part)]
        text, behind = text or "", after[1] or ""
        edit = len(text) // 4
        edited = text[: len(text) - edit] + behind[:edit]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(pieces(text), pieces(edited)))
        assert r["near_next"] == pytest.approx(jaccard(pieces(text), pieces(behind)))
        for tries, near, other in ((r["retries_edited"], r["near_edited"], r["edited_fingerprint"]), (r["retries_next"], r["near_next"], got[after[0]]["fingerprint"])):
            alone = likeness_of(r["fingerprint"], other)
            assert (alone is not None) == (tries == 0)
            if tries == 0:
                peeled += 1
                assert alone == pytest.approx(near)
        assert by.setdefault(text, r["fingerprint"]) == r["fingerprint"] and by.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
    return peeled


def test_fingerprints(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in registry.op7_paragraph_iblt(spark, sf_dir).collect()}
    assert check_fingerprints(texts, got) > len(texts) // 2
    assert {r["retries_next"] for r in got.values()} & {1, 2}


@pytest.mark.parametrize("settings", [IbltSettings(broadcast_rows=0, block_rows=7), IbltSettings(retries=0), IbltSettings(share=0.05, retries=1, rounds=2)])
def test_fingerprints_by_other_ways(spark, texts, settings):
    """By shuffles, and with tables that are too small, so that the lists of digests decide."""
    part = texts[:40]
    got = {r["doc_id"]: r for r in version_fingerprints(spark.createDataFrame(part, "doc_id long, text string"), settings).collect()}
    for k, (i, text) in enumerate(part):
        after = part[(k + 1) % len(part)][1]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert got[i]["near_edited"] == pytest.approx(jaccard(pieces(text), pieces(edited)))
        assert got[i]["near_next"] == pytest.approx(jaccard(pieces(text), pieces(after)))
    assert settings.retries or settings.retries + 1 in {r["retries_next"] for r in got.values()}


def test_differences_are_recovered(spark):
    rows = [("\n".join(f"line {k}" for k in range(n)), "\n".join(f"line {k}" for k in range(3, n + m))) for n, m in ((5, 2), (80, 40), (0, 0))]
    pairs = spark.createDataFrame(rows, "old string, new string")
    for settings in (IbltSettings(), IbltSettings(share=0.01, retries=0)):
        for r in recovered_differences(pairs, "old", "new", settings).collect():
            a, b = pieces(r["old"]), pieces(r["new"])
            assert (len(set(r["only_old"])), len(set(r["only_new"]))) == (len(a - b), len(b - a))
            assert len(set(r["only_old"])) == len(r["only_old"])


def test_fingerprints_of_odd_rows(spark, odd, empty):
    got = version_fingerprints(odd).toPandas()
    assert len(got) == odd.count() and got["near_next"].between(0, 1).all()
    four = got[got["doc_id"] == 4].iloc[0]
    assert four["near_edited"] == 1 and four["near_next"] == 1 and four["n_chars"] == 0
    long = {r["doc_id"]: r["text"] for r in odd.where("doc_id in (7, 8)").collect()}
    seven, edit = got[got["doc_id"] == 7].iloc[0], len(long[7]) // 4
    assert seven["n_chars"] == len(long[7]) and seven["near_next"] == 0
    assert seven["near_edited"] == pytest.approx(jaccard(pieces(long[7]), pieces(long[7][: len(long[7]) - edit] + long[8][:edit])))
    assert version_fingerprints(empty).count() == 0
    one = version_fingerprints(spark.createDataFrame([(3, "abcd efgh")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_next_ids_in_blocks(spark):
    ids = spark.createDataFrame([(i * 3, 1) for i in range(500)] + [(None, 1)], "doc long, n int")
    got = {r["doc"]: r["next"] for r in next_ids(ids, IbltSettings(block_rows=20)).collect()}
    order = [None, *(i * 3 for i in range(500))]
    assert got == {a: b for a, b in zip(order, [*order[1:], None], strict=True)}


# Quotations.

MESSAGES = [
    (1, 0, "u", "Hello  there\nfriend\n\nSecond para"),
    (1, 1, "a", "> hello there\n> friend\nMy answer"),
    (1, 2, "u", ">> Hello there\n>> friend\n> My Answer\nthanks"),
    (1, 3, "a", "> second para\n> nothing known\n\n>   My answer\nok"),
    (1, 4, "u", "no quote"),
    (1, 5, "u", "> > my answer\n> thanks\n> \n> ok\nfine"),
    (1, 6, "u", "> fine"),
    (2, 0, "u", "x"),
    (2, 1, "a", ""),
    (2, 2, "a", "> hello there\n> friend"),
    (3, 1, "u", ">"),
]
MESSAGE_SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(pdf):
    columns = sorted(pdf.columns)
    return sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in pdf[columns].astype(object).values.tolist())


def test_quotations_against_sql(spark):
    df = spark.createDataFrame(MESSAGES, MESSAGE_SCHEMA)
    got = link_conversations(df).toPandas()
    c = duckdb.connect()
    c.register("conversations", df.toPandas())
    assert rows_of(got) == rows_of(c.sql(quote_links.ORACLE_SQL).df())
    first = got[got["conv_id"] == 1].sort_values("position")
    assert first["turn"].tolist() == [0, 1, 2, 3, 5, 6, 4] and first["depth"].tolist() == [0, 1, 2, 2, 3, 4, 0]
    assert not first["text"].str.contains(">").any()


def test_quotations_of_odd_rows(spark):
    more = [(None, 1, "a", "> x"), (4, None, "u", "z"), (5, 0, None, None), (5, 0, "u", "y"), (5, 0, "u", "y"), (5, 1, "a", "> y\n\n" + "> long " * 5000)]
    df = spark.createDataFrame(MESSAGES + more, MESSAGE_SCHEMA).withColumn("lines", F.lit(1)).withColumn("root", F.lit(1)).withColumn("conv", F.lit(2))
    got = link_conversations(df).toPandas()
    assert len(got) == len(MESSAGES) + len(more)
    five = got[got["conv_id"] == 5].sort_values("position")
    assert five["position"].tolist() == [0, 1, 2, 3] and five["parent"].tolist()[3] == 0 and five["text"].tolist()[0] is None
    assert link_conversations(df.limit(0)).count() == 0


# Dated lists.


def test_temporal_lists(spark):
    entries = [("l", "bad.com", 1, 100), ("l", "bad.com", 0, 200), ("l", "a.bad.com", 0, 50), ("l", "a.bad.com", 1, 400), ("k", "x.org", 1, 0), ("k", "x.org", 0, 0), (None, "y", 1, 0), ("m", None, 1, 0), ("m", "z.com", 1, None)]
    captures = [
        (1, "http://www.BAD.com:80/x?y", 99),
        (2, "http://www.bad.com./", 100),
        (3, "https://u@bad.com/", 199),
        (4, "http://bad.com", 200),
        (5, "http://a.bad.com/", 150),
        (6, "http://a.bad.com/", 10_000),
        (7, None, 5),
        (8, "not a url", 5),
        (9, "http://x.org/", 5),
        (None, "http://x.org/", 5),
        (10, "http://x.org/", None),
        (9, "http://x.org/", 5),
    ]
    c = spark.createDataFrame(captures, "id long, url string, at long").withColumn("pattern", F.lit("p")).withColumn("start", F.lit(1))
    e = spark.createDataFrame(entries, "list string, pattern string, action int, at long")
    got = temporal_join(c, e, period_s=60).toPandas()
    by = {r["id"]: (r["pattern"], bool(r["blocked"])) for r in got.dropna(subset=["id"]).to_dict("records")}
    assert len(got) == len(captures)
    assert by == {1: (None, False), 2: ("bad.com", True), 3: ("bad.com", True), 4: ("bad.com", False), 5: ("a.bad.com", False), 6: ("a.bad.com", True), 7: (None, False), 8: (None, False), 9: ("x.org", True), 10: (None, False)}
    assert got[got["id"].isna()]["blocked"].all()
    # A cleared entry of one list doesn't hide a block of another one at the same pattern.
    two = spark.createDataFrame([("ads", "q.net", 1, 0), ("ads", "q.net", 0, 10), ("malware", "q.net", 1, 5), ("malware", "q.net", 0, 90)], "list string, pattern string, action int, at long")
    asked = spark.createDataFrame([(1, "http://q.net/", 7), (2, "http://w.q.net/", 20), (3, "http://q.net/", 95)], "id long, url string, at long")
    got = {r["id"]: (r["list"], r["blocked"]) for r in temporal_join(asked, two).collect()}
    assert got == {1: ("ads", True), 2: ("malware", True), 3: ("ads", False)}
    c = spark.createDataFrame(captures, "id long, url string, at long")
    assert temporal_join(c.limit(0), e).count() == 0 and not temporal_join(c, e.limit(0)).where("blocked").count()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert rows_of(got.round(9).astype(object)) == rows_of(c.sql(registry.oracle_sql()[name]).df().round(9).astype(object))


def test_sql_modules():
    assert temporal_lists.ORACLE_SQL and containment.ORACLE_SQL


# Memory.


def _peak_growth(code):
    """MB that a piece of code adds to the peak memory of a fresh process."""
    import subprocess
    import sys

    run = "import resource\n%s\nbefore = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nwork()\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)"
    return float(subprocess.run([sys.executable, "-c", run % code], capture_output=True, text=True, check=True, timeout=300).stdout.split()[-1])


def test_memory_of_a_block_of_small_sets():
    code = """
import numpy as np, pyarrow as pa
from smoothspan.llm.blockwise import overlaps
r = np.random.default_rng(1)
sets = pa.array([sorted(set(r.integers(0, 3000, 6).tolist())) for _ in range(11000)], pa.list_(pa.int64()))
def work():
    assert sum(len(part) for part, both, union in overlaps(sets, np.arange(2048))) == 2048
"""
    assert _peak_growth(code) < 250


def test_memory_of_a_long_text():
    code = """
import pyarrow as pa
from smoothspan.llm.super_minhash import MinHashSettings, sign_column
text = pa.array([" ".join(f"word{i % 9777} part{i % 31}" for i in range(1_500_000))])
def work():
    assert sign_column(text, MinHashSettings())[0][0] > 100_000
"""
    assert _peak_growth(code) < 300


def test_words_and_signatures_in_parts(monkeypatch):
    """A scan by small pieces, and a signature of parts of a set, give the same as the whole."""
    import numpy as np
    import pyarrow as pa

    from smoothspan.llm import bytescan
    from smoothspan.llm.super_minhash import super_minhash

    texts = ["Ab cd\n" + "x" * 300 + " é " * 40, "", "one", " two  three\t" * 30]
    raw, offsets = bytescan.text_buffers(pa.array(texts))
    whole = bytescan.words(raw, offsets)
    for size in (1, 3, 64):
        monkeypatch.setattr(bytescan, "BLOCK_BYTES", size)
        monkeypatch.setattr(bytescan, "_powers", {})
        assert all(np.array_equal(a, b) for a, b in zip(whole, bytescan.words(raw, offsets)))
    owner, item = np.repeat(np.arange(3), [5, 400, 90]), np.arange(495, dtype=np.uint64)
    assert np.array_equal(super_minhash(owner, item, 4, 64), super_minhash(owner, item, 4, 64, most_items=37))
