import math
import random

import numpy as np
import pytest

from castline.llm import queries, url_filters
from castline.llm.embedding_dedup import near_duplicates
from castline.llm.url_filters import judge_urls
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr", "allow"), ("a.org", "/fr/x", "block"), ("b.org", "", "block"), ("EXAMPLE.com", "/de/", "block"), ("b.org", "", "allow")]


def judged(url, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h) + len(p), len(h), v, h.lower() + p) for h, p, v in RULES if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[2] if best else default


def test_urls_equal_the_definition(spark):
    rng = random.Random(1)
    urls = [None, "", "no url", "http://", "HTTP://NET", "http://net/", "x://y://net/", "http://org?q=/fr", "http://a.ORG/fr/x/y#z", "http://www.b.org", "http://b.org/", "http://" + "a." * 300 + "net/" + "p/" * 500, "http://x.example.net/en/\nnew", "ÄÖ://Ä.net/"]
    urls += ["http://" + rng.choice(["a.org", "x.a.org", "org", "example.net", "m.example.com", "knet"]) + "".join("/" + rng.choice(["fr", "en", "de", "x", ""]) for _ in range(rng.randint(0, 4))) for _ in range(200)]
    rows = [(i, u, 1) for i, u in enumerate(urls)] + [(None, "http://net/", 1), (1, "", 1), (7, urls[7], 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted((tuple(r) for r in judge_urls(pages, rules).collect()), key=str)
    assert got == sorted(((i, *judged(u)) for i, u, _ in rows), key=str)
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.limit(0), "block").collect()} == {"block"}


def test_urls_with_shuffled_rules(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://{h}.org/fr/x/{i}") for i in range(50) for h in ("a", "b")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    want = sorted(map(tuple, judge_urls(pages, rules).collect()))
    monkeypatch.setattr(url_filters, "BROADCAST_RULES", 0)
    assert sorted(map(tuple, judge_urls(pages, rules).collect())) == want and len(want) == 100


def test_urls_run_no_python(spark):
    plan = queries.op5_url_filter(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_url_query_equals_sql(spark):
    con = connect(SF)
    for name, sql in queries.ORACLE_SQL.items():
        assert_same(queries.QUERIES[name](spark, SF), con, sql)


def brute(rows, cosine=0.98):
    good = [(i, np.asarray(v, float), label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(good))}
    for a in range(len(good)):
        for b in range(a):
            (_, x, lx), (_, y, ly) = good[a], good[b]
            if lx == ly and len(x) == len(y) and (x == y).all() or (lx == ly and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine):
                links[a].add(b)
                links[b].add(a)
    return good, links


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(size=16) * rng.choice([0.0, 0.03, 0.05])).astype(np.float32).tolist(), int(i % 3)) for i in range(300)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None], 1), (1004, rows[0][1], None), (None, rows[0][1], 0), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1), (1007, [], 1), rows[5]]
    vectors = spark.createDataFrame([(i, v, label, 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, copies int")
    got = near_duplicates(vectors).collect()
    assert len(got) == len(rows)
    good, links = brute(rows)
    want, have = {}, {r.vec_id: r for r in got if r.vec_id is not None}
    for k, (i, _, _) in enumerate(good):
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        want[i] = (len(links[k]), min(good[m][0] for m in seen))
    found = sum(min(have[i].n_links, n) for i, (n, _) in want.items())
    assert all(have[i].n_links <= n for i, (n, _) in want.items())
    assert found >= 0.9 * sum(n for n, _ in want.values())
    if found == sum(n for n, _ in want.values()):
        assert {i: have[i].component_id for i in want if i is not None} == {i: c for i, (_, c) in want.items() if i is not None}
    for r in got:
        if r.vec_id is not None:
            assert r.kept == (r.vec_id == r.component_id)
    for i in (1000, 1001, 1002, 1003, 1004, 1007):
        assert (have[i].n_links, have[i].component_id, have[i].kept) == (0, i, True)
    assert near_duplicates(vectors.limit(0)).count() == 0


def test_embeddings_whose_ids_recur(spark):
    v, u = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.5, 0.0]
    near = [1.0, 0.01, 0.0, 0.1]
    rows = [(1, v, 1), (2, near, 1), (1, u, 2), (3, u, 1), (3, v, 1), (3, near, 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = near_duplicates(vectors).collect()
    # v, near and the copy of v under another id are one group; no other two of a label are alike.
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (3, 0, 3, True), (3, 2, 1, False)]


def pairs_at(rng, n, width, mean, low=0.98, high=0.985):
    """Vectors about a common mean of the given norm, every second one at a cosine of ``low`` to ``high`` from the one before."""
    centre = np.zeros(width)
    centre[0] = mean
    own = rng.normal(size=(n, width))
    own = centre + own / np.linalg.norm(own, axis=1, keepdims=True) * np.sqrt(1 - mean**2)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    way = rng.normal(size=(n, width))
    way -= (way * own).sum(axis=1, keepdims=True) * own
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    cosine = rng.uniform(low, high, (n, 1))
    return np.stack([own, cosine * own + np.sqrt(1 - cosine**2) * way], axis=1).reshape(2 * n, width)


@pytest.mark.parametrize(("width", "mean"), [(64, 0.0), (64, 0.9), (128, 0.9), (64, 0.95), (64, 0.985)])
def test_embedding_recall_with_a_common_mean(spark, width, mean):
    vectors = pairs_at(np.random.default_rng(7), 1500, width, mean)
    near = vectors @ vectors.T >= 0.98
    np.fill_diagonal(near, False)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    got = {r.vec_id: r.n_links for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i] <= n for i, n in enumerate(near.sum(axis=1)))
    assert sum(got.values()) >= 0.95 * near.sum()


def test_embedding_groups_and_threshold(spark):
    """Two groups of near vectors are found whole; cosine exactly at the threshold links, one below does not."""
    rng = np.random.default_rng(2)
    groups = rng.normal(size=(2, 32))
    rows = [(10 * i + 5, (groups[i % 2] + rng.normal(size=32) * 0.01).tolist(), 1) for i in range(60)]
    # (3, 4) and (4, 3) have a cosine of 24 / 25.
    rows += [(1000, [3.0, 4.0], 2), (1001, [4.0, 3.0], 2), (1002, [3.0, 4.0], 3), (1003, [4.0, 2.9999999], 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicates(vectors).collect()}
    assert all(got[10 * i + 5] == (29, 5 + 10 * (i % 2), i < 2) for i in range(60))
    got = {r.vec_id: r.component_id for r in near_duplicates(vectors, cosine=24 / 25).collect()}
    assert [got[i] for i in (1000, 1001, 1002, 1003)] == [1000, 1000, 1002, 1003]


def test_every_operator_has_a_query():
    assert [f"op{i}_" for i in range(1, 14)] == [n[: n.index("_") + 1] for n in queries.QUERIES]


def test_pipeline_without_labels(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 ... ##"), (None, "a text"), (None, "12")], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").unionByName(odd).collect()]
    docs = spark.createDataFrame([(i, t, None, "x", len(t or "")) for i, t in rows], table.schema)
    got = corpus_pipeline.keep_known_language(spark, docs, SF)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    want = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, rows = {r.doc_id for r in docs.collect()}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF).cache()
        assert rows.columns == list(corpus_pipeline.COLUMNS), name
        now = {r.doc_id for r in rows.collect()}
        assert now <= ids and rows.count() == len(now)
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()
    assert {r.doc_id for r in packed} == ids
    assert sorted(map(str, packed)) and len(packed) == corpus_pipeline.run(spark, SF).count()
    assert corpus_pipeline.run.__doc__
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def odd_documents(spark, extra):
    """A few documents with null ids and texts, repeats, a shared id, empty texts and clashing columns."""
    rows = [(None, "no id here at all and more", "en"), (None, "no id here at all and more", "en"), (7, None, "en"), (8, "", "en"), (8, "", "en"), (9, "...", "en"), (10, "the king and the house of the queen", "en"), (10, "eine ganz andere geschichte von der stadt", "de"), (11, "the king and the house of the queen", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} int" for c in extra)
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *[1] * len(extra)) for i, t, lang in rows], schema)


CLASHING = ("lang_pred", "score", "n_lines", "n_dropped", "doc_key", "_key", "_id", "kept", "component_id", "length", "piece", "ids")


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    docs = odd_documents(spark, CLASHING)
    got = p.keep_known_language(spark, docs, SF)
    assert got.columns == list(p.COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(i, t) for i, t in ((r.doc_id, r.text) for r in docs.collect()) if t and any(c.isalpha() for c in t)], key=str)

    line = "one line that stands in each of the documents"
    twice = spark.createDataFrame([(i, f"{line}\n{t}", "en", "s", 1, *[1] * len(CLASHING)) for i, t in ((1, "own a"), (2, ""), (3, "own c"), (3, "own c"), (None, "d"))], docs.schema)
    got = p.drop_shared_lines(spark, twice.unionByName(docs.where("text IS NULL OR text = ''")), SF)
    assert got.columns == list(p.COLUMNS)
    kept = sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=str)
    # The row without an id is the first document; what is left of document 2 is nothing, so it goes.
    assert kept == sorted([(None, f"{line}\nd", 1), (1, "own a", 5), (3, "own c", 5), (3, "own c", 5), (7, None, 0), (8, "", 0), (8, "", 0)], key=str)

    got = p.keep_one_of_each_group(spark, docs, SF)
    assert got.columns == list(p.COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(None, "no id here at all and more"), (7, None), (8, ""), (9, "..."), (10, "the king and the house of the queen"), (10, "eine ganz andere geschichte von der stadt")], key=str
    )

    got = p.pack(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
    assert all(r.length >= 1 and r.offset + r.length <= 2048 for r in got)


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage on its own input: the lines, the groups and the pieces by plain Python."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from castline.llm import line_templates
    from tests.llm.test_text_operators import dropped, groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = p.keep_known_language(spark, docs, SF)
    texts = {r.doc_id: r.text for r in known.collect()}
    assert set(texts) == {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}

    rows = sorted(texts.items())
    gone = dropped(rows) | long_repeats(rows)
    thin = {}
    for i, text in rows:
        lines = [line for at, line in enumerate(text.split("\n")) if (i, at) not in gone]
        if len(lines) == len(text.split("\n")) or "\n".join(lines).strip():
            thin[i] = "\n".join(lines)
    got = p.drop_shared_lines(spark, known, SF)
    assert {r.doc_id: r.text for r in got.collect()} == thin
    assert line_templates.LONG_TOKENS == 50

    single = p.keep_one_of_each_group(spark, got, SF)
    first = groups(sorted(thin.items()))
    kept = {r.doc_id: r.text for r in single.collect()}
    assert kept == {i: t for i, t in thin.items() if first[i] == i}

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = p.pack(spark, single, SF).toPandas()
    lengths = pieces.groupby("doc_id").length.sum()
    assert lengths.to_dict() == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}


def long_repeats(rows):
    """Lines of 50 tokens or more that an earlier document has, digits aside."""
    from castline.llm import line_templates

    seen, gone = {}, set()
    for i, text in rows:
        for at, line in enumerate(text.split("\n")):
            tokens = tuple(line_templates.masked(line))
            if len(tokens) >= line_templates.LONG_TOKENS and line_templates.has_letter(" ".join(tokens)) and seen.setdefault(tokens, i) != i:
                gone.add((i, at))
    return gone


def test_scratch_is_deleted(spark, tmp_path):
    from castline.llm.common import discard, scratch, shared_dir, stored

    place = shared_dir(spark).removeprefix("file://")
    import os

    before = set(os.listdir(place))
    with scratch(spark) as keep:
        stored(spark.range(3), "one")
        two = keep(stored(spark.range(4), "two"))
    assert len(set(os.listdir(place)) - before) == 1 and two.count() == 4
    discard(two)
    assert set(os.listdir(place)) == before
    import corpus_pipeline

    rows = corpus_pipeline.stage_rows(spark, corpus_pipeline.keep_one_of_each_group, spark.read.parquet(f"{SF}/documents.parquet"), SF, "ngram_join")
    assert len(set(os.listdir(place)) - before) == 1
    discard(rows)
