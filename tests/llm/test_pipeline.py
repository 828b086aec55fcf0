"""The pipeline and the identifiers' graph against plain Python versions."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quarrylens.llm import common, language, packing, pii, quality
from tests.llm.test_queries import DIR, EN, docs, linked, near_threshold


def brute_patterns(texts):
    """pattern -> (score, kind), by rounds over a dictionary of the whole graph."""
    held, seed, never = defaultdict(set), {}, {}
    for text in texts:
        for _, value, kind, patterns in pii.candidates(text or ""):
            never[value] = pii.refuted(value)
            for p in patterns:
                held[p].add(value)
                if kind and seed.get((p, value), "") < kind:
                    seed[p, value] = kind
    accepted = {}
    seeds = {(v, k) for (_, v), k in seed.items()}
    known = {v for v, _ in seeds}
    while True:
        sure = [(v, k, 1.0) for v, k in seeds]
        lifted = defaultdict(list)
        for p, values in held.items():
            if p in accepted:
                for v in values:
                    if (p, v) not in seed and never[v] != accepted[p][1] and v not in known:
                        lifted[v].append(accepted[p])
        sure += [(v, max(x)[1], max(x)[0]) for v, x in lifted.items()]
        by = defaultdict(list)
        for v, k, r in sure:
            by[v].append((k, r))
        new = {}
        for p, values in held.items():
            if p in accepted:
                continue
            scores = defaultdict(list)
            for v in values:
                for k, r in by[v]:
                    scores[k].append(r)
            good = [(round(sum(r) / len(values), 9), k) for k, r in scores.items() if len(r) >= pii.MIN_SUPPORT[p[0]] and round(sum(r) / len(values), 9) >= pii.MIN_SCORE[p[0]]]
            if good:
                new[p] = max(good)
        if not new:
            return accepted
        accepted |= new


def brute_redacted(text, accepted):
    out, at = "", 0
    for start, value, kind, patterns in pii.candidates(text):
        kind = kind or max((accepted[p] for p in patterns if p in accepted and accepted[p][1] != pii.refuted(value)), default=(0, None))[1]
        if kind:
            out, at = out + text[at:start] + f"[{kind.upper()}]", start + len(value)
    return out + text[at:]


def test_findings_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    rows += [f"badge no {rng.choice('ABCD')}{rng.randrange(10**6):06d} of jane{i}@example.org" for i in range(9)] + [f"badge no Z{i:07d} alone" for i in range(4)] + [f'api_key = "{rng.randrange(16**12):x}abcd12345{i}" next' for i in range(8)] + ['api_key = "zz-9" and api_key = "a9" next'] * 3
    # a chain of patterns: each is lifted by the one before
    for step in range(9):
        rows += [f"mark{step} is here id-{step}{i:03d}-x then mark{step + 1} was here id-{step}{i:03d}-x" for i in range(12)]
    rows += [f"mark0 is here m{i}@example.org" for i in range(80)]
    want = brute_patterns(rows)
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.pattern: (r.score, r.kind) for r in pii.bootstrap(pii.occurrences(d)).collect()}
    assert {p: k for p, (_, k) in got.items()} == {p: k for p, (_, k) in want.items()}
    assert all(abs(got[p][0] - want[p][0]) < 1e-6 for p in want)
    assert {r.doc_id: r.text for r in pii.redacted(d).collect()} == {i: brute_redacted(t or "", want) for i, t in enumerate(rows)}


def vote(model, vector, k=quality.NEIGHBOURS):
    sims = np.round(model.vectors @ vector, 6)
    near = sorted(range(len(sims)), key=lambda i: (-sims[i], i))[:k]
    w = [max(0.0, float(sims[i])) ** 4 for i in near]
    return (sum(a * model.votes[i] for a, i in zip(w, near, strict=True)) + 1e-9) / (sum(w) + 2e-9)


def closure(texts):
    """id -> smallest id of its group, by all pairs."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = common.lower_words(t)
        sets[i] = {tuple(w[j : j + 2]) for j in range(max(1, len(w) - 1))} if w else set()
    links = [(a, b) for a in texts for b in texts if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.65 * len(sets[a] | sets[b])]
    for _ in texts:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root
    return root


def test_run_equals_plain_python(spark):
    got = corpus_pipeline.run(spark, DIR).collect()
    d, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    rows = d.collect()
    model, ids = quality.fit(d, labels), quality.Ids()
    rows = [r for r in rows if r.text and vote(model, model.embed([quality.features(r.text, ids)])[0]) >= quality.THRESHOLD]
    net = language.fit(spark.createDataFrame(rows, d.schema))
    rows = [r for r in rows if language.pooled(net, [r.text.encode()])[0].max() >= language.MIN_CONFIDENCE]
    root = closure({r.doc_id: r.text for r in rows})
    rows = [r for r in rows if root[r.doc_id] == r.doc_id]
    accepted = brute_patterns([r.text for r in rows])
    want = {r.doc_id: (brute_redacted(r.text, accepted), r.source, r.lang) for r in rows}
    texts, columns = defaultdict(str), {}
    for r in sorted(got, key=lambda r: r.chunk):
        texts[r.doc_id] += r.text
        columns[r.doc_id] = (r.source, r.lang)
        assert r.n_chars == len(r.text)
        assert r.length == len(r.text.encode().split())
    assert len(want) > 50
    assert {i: (t, *columns[i]) for i, t in texts.items()} == want
    bins_are_fullest(got, packing.CAPACITY)


def bins_are_fullest(got, capacity):
    """Every group's bins are those of the plain packing of its pieces; full pieces are alone."""
    by = defaultdict(list)
    for r in got:
        by[r.bin_group].append(r)
    for own in by.values():
        bins = defaultdict(list)
        for r in own:
            bins[r.bin].append(r)
        for b in bins.values():
            b.sort(key=lambda r: r.position)
            assert [r.position for r in b] == list(range(len(b)))
            assert [r.offset for r in b] == [sum(x.length for x in b[:i]) for i in range(len(b))]
            assert {sum(r.length for r in b) + r.slack for r in b} == {capacity}
        rest = sorted((r for r in own if r.length < capacity), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.chunk))
        sizes = [r.length for r in rest]
        plain = sorted(sorted(sizes[i] for i in b) for b in packing.minimum_slack(sizes, capacity))
        assert sorted(sorted(r.length for r in b) for b in bins.values() if b[0].length < capacity) == plain


def test_packed_rows(spark):
    d = docs(spark)
    got = packing.packed_texts(d, capacity=50, group_items=4).collect()
    texts = defaultdict(list)
    for r in got:
        assert r.n_chars == len(r.text)
        texts[r.doc_id, r.chunk].append(r.text)
    assert "".join(texts[7, i][0] for i in range(80)) == "wörter " * 4000
    assert len(texts[3, 0]) == 2
    assert {i for i, _ in texts} == {1, 2, 3, None, 6, 7, 8, 9, 10}
    assert packing.packed_texts(d).columns == [*d.columns, "chunk", "length", "bin_group", "bin_", "position", "offset", "slack"]
    many = spark.createDataFrame([(1, "same words", i) for i in range(900)] + [(i, "x " * (i % 60), 0) for i in range(300)], "doc_id long, text string, chunk int")
    plain = packing.pack(many, capacity=50, group_items=64)
    bins_are_fullest(plain.collect(), 50)
    most = plain.groupBy("bin_group").count().agg({"count": "max"}).first()[0]
    assert most < 200  # the many rows alike are spread


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_rows(name, stage, spark):
    d = docs(spark)
    got = stage(spark, d, DIR)
    rows = got.collect()
    assert got.columns[: len(d.columns)] == d.columns
    if name != "packing":
        assert got.schema == d.schema
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r.text)
    if name in ("quality", "language", "packing"):
        assert not {4, 5} & set(by)  # null and empty texts
    else:
        assert by[4] == [None]
        assert by[5] == [""]
    if name == "near_copies":
        assert 3 not in by
        assert len(by[None]) == 1
    elif 3 in by:
        assert by[3] == [EN, EN]
    if name == "personal_data":
        assert by[6] == ["mail me: [EMAIL] or [PHONE]"]
    assert stage(spark, d.limit(0), DIR).count() == 0


def test_one_copy_of_each_group_of_all_pairs(spark):
    rows = near_threshold()
    group = linked(rows)
    left = corpus_pipeline.one_copy(spark, spark.createDataFrame(rows, "doc_id long, text string"), DIR)
    assert sorted(r.doc_id for r in left.collect()) == [i for i, _ in rows if group.get(i, (i,))[0] == i]


@pytest.mark.parametrize("ends", [(), (-(1 << 63), (1 << 63) - 1)])
def test_one_copy_among_rows_without_an_id(ends, spark):
    rng, near = random.Random(8), near_threshold()
    # linked() names a group by its smallest number: ids first, then texts
    texts = [t for i, t in near if i % 3 == 0]
    no_id = sorted({t for i, t in near if i % 3})
    named = [*ends, *range(5, 5 + len(texts) - len(ends))]
    group = linked(list(enumerate(texts + no_id)))
    stay = {k for k in range(len(texts + no_id)) if group.get(k, (k,))[0] == k}
    rows = [*zip(sorted(named), texts, strict=True), *((None, t) for t in no_id), *((None, t) for t in rng.sample(no_id, 60)), (None, None), (None, None), (None, "..."), (None, "...")]
    rng.shuffle(rows)
    left = corpus_pipeline.one_copy(spark, spark.createDataFrame(rows, "doc_id long, text string"), DIR)
    want = [(sorted(named)[k], texts[k]) if k < len(texts) else (None, no_id[k - len(texts)]) for k in stay]
    assert len(stay) < len(texts + no_id) - 40
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [*want, (None, None), (None, None), (None, "..."), (None, "...")]))


def test_one_copy_of_rows_alike_without_an_id(spark):
    rows = [(None, EN, {"k": 2}), (None, EN, {"k": 1}), (None, EN + " finally", {"k": 0}), (None, "alone here", {"k": 3}), (4, EN + " at last", {"k": 9})]
    d = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    left = corpus_pipeline.one_copy(spark, d, DIR)
    assert left.schema == d.schema
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [rows[3], rows[4]]))
    left = corpus_pipeline.one_copy(spark, d.where("doc_id is null"), DIR)
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [rows[1], rows[3]]))


def test_one_copy_tells_words_of_one_checksum_apart(spark):
    # both words have the CRC-32 4ddb0c25: 13 of 20 pairs of words are shared, of which the two that differ in them would be one
    text = "a plumless b a buckeroo b c d e f g h i j".split()
    rows = [(1, " ".join([*text, "k", "l", "m"])), (2, " ".join([*text, "n", "o", "p", "q"]))]
    assert closure(dict(rows)) == {1: 1, 2: 1}
    left = corpus_pipeline.one_copy(spark, spark.createDataFrame(rows, "doc_id long, text string"), DIR)
    assert [r.doc_id for r in left.collect()] == [1]
