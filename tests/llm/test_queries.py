"""Operators and pipeline on small tables with awkward rows, and against SQL."""

import random

import duckdb
import numpy as np
import pytest

import quarrylens.llm.components
from quarrylens.llm import common, fingerprint, jaccard, language, licenses, neardup, pieces, pii, quality, queries, warc
from quarrylens.llm.components import components

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, n long, bin long, v string"
EN = "the quick brown foxes jumped over several lazy dogs while reading interesting newspapers about distant countries and their remarkable customs"


def docs(spark):
    rows = [
        (1, EN, "en"), (2, EN + " finally", "en"), (3, EN, "en"), (3, EN, "en"), (4, None, "en"), (5, "", None), (None, "Ein kleiner Text ohne Nummer 4111111111111111", "de"), (6, "mail me: jane@example.org or +1 (555) 010-4242", "en"),
        (7, "wörter " * 4000, "de"), (8, "Released under the MIT License.", "en"), (9, "!!! ??? ###", None), (10, " ".join(f"unique{i} phrase{i * 7}" for i in range(200)), "en"),
    ]
    return spark.createDataFrame([(i, t, lang, "s", len(t) if t else None, 1, 2, 3, "x") for i, t, lang in rows], SCHEMA)


def test_groups(spark):
    got = {r.doc_id: (r.group_id, r.n_linked) for r in jaccard.groups(docs(spark)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2)}
    left = jaccard.one_of_each(docs(spark))
    assert left.columns == docs(spark).columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 10]
    assert jaccard.groups(docs(spark).limit(0)).count() == 0


def test_copies_of_any_script_are_groups(spark):
    rng, rows = random.Random(2), []
    kinds = ["क ख ग कि खी गु हिन्दी भाषा में".split(), "กิ ขี ประเทศ ไทย ที่ นี้".split(), [str(i) for i in range(999)], "a of to in it is be".split(), ["中文", "汉字", "你好"]]
    for k, words in enumerate(kinds):
        for n in (1, 2, 12, 13, 25, 60, 71, 97, 300, 1500):
            text = " ".join(rng.choice(words) for _ in range(n)) + f" {k}x{n}"
            rows += [(len(rows), text), (len(rows) + 1, text.upper() + " !")]
    got = {r.doc_id: r.group_id for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == got[i + 1] for i in range(0, len(rows), 2))


def near_threshold():
    """Texts of many sizes, each with others whose similarity to it lies about the threshold."""
    rng, rows = random.Random(5), []
    for n in (2, 3, 5, 8, 12, 20, 24, 25, 30, 36, 48, 60, 96, 200):
        for words in 6 * [[f"w{i}" for i in range(3000)]] + 2 * [[f"v{i}" for i in range(40)]]:
            text = [rng.choice(words) for _ in range(n + 1)]
            cut = round(n * 0.35 / 1.65) + rng.choice((-1, 0, 0, 1))
            rows += [text, text[max(cut, 0) :] + [rng.choice(words) for _ in range(cut)], text[: round((n + 1) * 0.655)]]
    return [(i, " ".join(t)) for i, t in enumerate(rng.sample(rows, len(rows)))]


def linked(rows):
    """The groups of all pairs."""
    sets = {i: {" ".join(w[k : k + 2]) for k in range(max(1, len(w) - 1))} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}
    for i, x in sets.items():
        for j, y in sets.items():
            if j < i and 20 * len(x & y) >= 13 * len(x | y) and root[i] != root[j]:
                gone, kept = max(root[i], root[j]), min(root[i], root[j])
                root = {k: kept if r == gone else r for k, r in root.items()}
    size = {r: sum(x == r for x in root.values()) for r in root.values()}
    return {i: (r, size[r] - 1) for i, r in root.items() if size[r] > 1}


def test_groups_are_those_of_all_pairs(spark):
    rows = near_threshold()
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.group_id, r.n_linked) for r in got.collect()} == linked(rows)


def test_groups_without_broadcast(spark, monkeypatch):
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    want = sorted(map(str, jaccard.groups(d).collect()))
    monkeypatch.setattr(common, "BROADCAST_IDS", -1)
    monkeypatch.setattr(quarrylens.llm.components, "ONE_TASK", -1)
    assert sorted(map(str, jaccard.groups(d).collect())) == want


def test_repeated_ids_with_maps(spark):
    rows = [(1, "b one", {"k": 1}), (1, "a one", {"k": 2}), (1, "a one", {"k": 1}), (None, None, None), (None, None, None)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>"))
    assert sorted(map(str, got.collect())) == sorted(["Row(doc_id=1, text='a one', m={'k': 1})"] + 2 * ["Row(doc_id=None, text=None, m=None)"])


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 9), (9, 7), (30, 20), (20, 10), (10, 1)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 20: 1, 30: 1, 5: 5, 7: 5, 9: 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_rounds(spark, monkeypatch):
    rng = random.Random(1)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(250)], "a long, b long")
    want = sorted(map(str, components(edges).collect()))
    monkeypatch.setattr(quarrylens.llm.components, "ONE_TASK", -1)
    assert sorted(map(str, components(edges).collect())) == want


def test_language_rows(spark):
    d = docs(spark)
    net = language.fit(d, steps=40)
    got = language.identified(d, net).collect()
    assert len(got) == d.count()
    assert {(r.lang_found, r.confidence, r.keep) for r in got if r.doc_id in (4, 5)} == {(None, 0.0, False)}
    assert next(r for r in got if r.doc_id == 7).n_bytes == len(("wörter " * 4000).encode())
    assert language.kept(d, net).columns == d.columns
    with pytest.raises(ValueError, match="languages"):
        language.fit(spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(300)], "doc_id long, text string, lang string"))
    same = language.fit(spark.createDataFrame([(1, "aaaa", "x"), (1, "aaaa", "y"), (None, "aaaa", None)], "doc_id long, text string, lang string"), steps=1)
    assert same.names == ["x", "y"]
    same.out[:], same.bias[:] = 0, 0
    assert language.identified(d, same).where("doc_id = 1").first().lang_found == "x"  # a tie
    none = language.fit(d.where("lang = 'xx'"))
    assert {r.lang_found for r in language.identified(d, none).collect()} == {None}
    assert language.identified(d.limit(0), net).count() == 0


def test_language_accuracy(spark):
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    got = language.identified(d, language.fit(d, sample_docs=25)).join(d.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_found").count() >= 0.97 * d.count()


def test_quality_rows(spark):
    d = docs(spark)
    labels = spark.createDataFrame([(1, 1, "c"), (1, 1, "c"), (9, 0, "c"), (None, 1, "c"), (8, None, "c")], "doc_id long, quality int, text string")
    m = quality.fit(d, labels)
    got = {r.doc_id: r for r in quality.scored(d, m).collect()}
    assert (got[4].quality_score, got[5].keep) == (0.0, False)
    assert got[1].keep
    assert not got[9].keep
    assert quality.kept(d, m).columns == d.columns
    two = spark.createDataFrame([(1, "zz yy"), (1, "aa bb")], "doc_id long, text string")
    assert {quality.fit(two.repartition(n), labels).votes.tolist() == [1.0] for n in (1, 2)} == {True}
    free = quality.fit(d, labels.limit(0))
    assert {r.keep for r in quality.scored(d, free).where("doc_id in (1, 9)").collect()} == {True}
    assert quality.scored(d.limit(0), m).count() == 0
    assert quality.fit(d.limit(0), labels).vectors.shape[0] == 0


def test_quality_accuracy(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = labels.where("doc_id % 3 = 0")
    m = quality.fit(d, labels.where("doc_id % 3 <> 0"))
    both = quality.scored(d, m).join(held, "doc_id")
    assert both.where("keep = (quality = 1)").count() >= 0.9 * held.count()


def test_pii_rows(spark):
    d = docs(spark)
    got = pii.findings(d).collect()
    assert {(r.doc_id, r.kind) for r in got} == {(None, "card"), (6, "email"), (6, "phone")}
    text = {r.doc_id: r.text for r in d.collect()}
    assert all(text[r.doc_id][r.start : r.start + r.length] == r.value for r in got)
    red = {r.doc_id: r for r in pii.redacted(d).collect()}
    assert red[6].text == "mail me: [EMAIL] or [PHONE]"
    assert red[6].n_chars == len(red[6].text)
    assert red[1].text == EN
    assert red[4].text is None
    assert pii.redacted(d).columns == d.columns
    assert pii.findings(d.limit(0)).count() == 0


def test_pii_discovers_what_no_validator_knows(spark):
    rows = [(i, f"member id: {c}{i:06d} joined") for i, c in enumerate("QRSTUV")]
    cards = [(100 + i, f"paid by 41111111111111{i:02d} today") for i in range(20)]
    secrets = [(200 + i, f'my token = "{i:06d}abcdefabcdefab" ok') for i in range(6)]
    other = [(300, 'my token = "sk-live-998877zz" ok')]
    found = pii.findings(spark.createDataFrame(rows + cards * 1 + secrets + other, "doc_id long, text string"))
    by = {r.doc_id: (r.kind, r.origin) for r in found.collect()}
    assert by[300] == ("secret", "pattern")
    assert not set(range(6)) & set(by)  # no seed is near them


def test_pii_without_broadcast(spark, monkeypatch):
    want = sorted(str(r) for r in pii.redacted(docs(spark)).collect())
    monkeypatch.setattr(pii, "BROADCAST_BYTES", -1)
    assert sorted(str(r) for r in pii.redacted(docs(spark)).collect()) == want


def test_fingerprint_rows(spark, monkeypatch):
    d = docs(spark)
    bench = spark.createDataFrame([(70, EN, "x"), (71, None, "x"), (None, EN, "x")], "item_id long, text string, passages string")
    got = fingerprint.fingerprints(d, bench).collect()
    assert len(got) == d.count()
    by = {r.doc_id: r for r in got}
    assert (by[3].first_copy, by[2].first_copy, by[4].first_copy, by[5].n_words) == (1, 2, 4, 0)
    assert [tuple(p) for p in by[2].passages] == [(70, 0, 0, len(EN.split()))]
    assert by[10].passages == []
    monkeypatch.setattr(fingerprint, "BROADCAST_BYTES", -1)
    again = {r.doc_id: r for r in fingerprint.fingerprints(d, bench).collect()}
    assert {k: v.passages for k, v in again.items()} == {k: v.passages for k, v in by.items()}
    assert fingerprint.fingerprints(d.limit(0), bench.limit(0)).count() == 0


def test_shuffled_passages_of_all_rows(spark, monkeypatch):
    rows = [(None, EN), (None, "other words " + EN), (1, EN + " more"), (1, "no passage here"), (1, "no passage here")]
    d, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(70, EN), (70, "x " + EN)], "item_id long, text string")
    want = sorted(map(str, fingerprint.fingerprints(d, bench).collect()))
    monkeypatch.setattr(fingerprint, "BROADCAST_BYTES", -1)
    assert sorted(map(str, fingerprint.fingerprints(d, bench).collect())) == want


def brute_repeats(texts, size):
    """Words of each text inside a window that another word sequence holds too."""
    words = {k: tuple(fingerprint.WORD.findall(t.lower())) for k, t in texts.items()}
    held = {}
    for w in set(words.values()):
        for i in range(len(w) - size + 1):
            held.setdefault(w[i : i + size], set()).add(w)
    return {k: {x for i in range(len(w) - size + 1) if len(held[w[i : i + size]]) > 1 for x in range(i, i + size)} for k, w in words.items()}, words


def test_passages_that_documents_share(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    shared, other, short = text(70), text(55), text(49)
    texts = {i: f"{text(rng.randrange(200))} {shared} {text(rng.randrange(300))}" for i in range(1, 30)}
    # the smallest id holds less of the passage than the others share with each other
    texts |= {0: text(40) + " " + " ".join(shared.split()[:52]) + " " + text(30), 40: other, 41: f"{text(9)} {other} {other} {text(9)}", 42: short + " " + text(60), 43: text(60) + " " + short, 44: text(200)}
    texts |= {45: texts[44], 46: texts[41].upper() + "!", 47: f"{shared} {other}"}
    rows = [*texts.items(), (41, texts[41]), (None, "x " + texts[44])]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == len(rows)
    want, words = brute_repeats(texts | {None: rows[-1][1]}, fingerprint.REPEAT)
    for r in got:
        assert {x for p in r.repeated for x in range(p.start, p.start + p.n_words)} == want[r.doc_id]
        for p in r.repeated:
            assert words[p.first_doc][p.first_start : p.first_start + p.n_words] == words[r.doc_id][p.start : p.start + p.n_words]
    by = {r.doc_id: r.repeated for r in got}
    assert max(p.n_texts for p in by[7]) == 31
    assert {len(by[i]) for i in range(1, 30)} == {2}
    assert by[42] == by[43] == []
    assert [tuple(p) for p in by[45]] == [(0, 200, 44, 0, 2)]


def test_licence_rows(spark):
    got = licenses.scan(docs(spark)).collect()
    assert [(r.doc_id, r.template, r.char_start, r.char_end) for r in got] == [(8, "MIT-line", 0, 30)]
    assert licenses.scan(docs(spark).limit(0)).count() == 0
    assert licenses.scan(docs(spark), templates={}).count() == 0


def test_piece_rows(spark):
    d = docs(spark)
    got = {r.doc_id: r for r in pieces.encoded(d).collect()}
    assert len(got) == d.select("doc_id").distinct().count()
    assert got[4].token_ids == got[5].token_ids == []
    assert all(r.round_trip for r in got.values())
    m = pieces.model(pieces.MODEL)
    assert got[1].token_ids == m.sp.encode(EN)
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(d)).collect()}
    assert back[7] == "wörter " * 4000
    assert pieces.encoded(d.limit(0)).count() == 0


def test_vector_rows(spark):
    a, b = [1.0, 0.0, 0.5] * 4, [1.0, 0.01, 0.5] * 4
    rows = [(1, a), (2, b), (3, a), (3, a), (None, a), (4, None), (5, []), (6, [0.0] * 12), (7, [float("nan")] * 12), (8, [1.0]), (9, [-x for x in a]), (10, [2.0]), (11, [-3.0]), (12, b), (12, [5.0] * 3)]
    d = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, class_id long, t string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(d).collect()), key=str)
    alone = [(i, i, 0) for i in (4, 5, 6, 7, 9, 11)]
    assert got == sorted([(1, 1, 3), (2, 1, 3), (3, 1, 3), (12, 1, 3), (8, 8, 1), (10, 8, 1), (None, None, 0), *alone], key=str)
    assert neardup.near_duplicates(d.limit(0)).count() == 0


def test_vectors_with_pairs_equal_sql(spark, monkeypatch, tmp_path):
    """The given vectors hold no pair, so here each third one gets near ones, some of them equal, and one gets many."""
    rng = np.random.default_rng(2)
    given = spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.stack(given["embedding"].to_numpy())
    rows = list(zip(given["vec_id"].tolist(), x.tolist(), strict=True))
    for i in (*range(0, len(x), 3), *[0] * 150):
        scale = np.linalg.norm(x[i]) / np.sqrt(x.shape[1])
        rows.append((10_000 + len(rows), (x[i] + rng.standard_normal(x.shape[1]) * scale * rng.choice([0.0, 0.1, 0.2, 0.25])).astype(np.float32).tolist()))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    d.write.parquet(str(tmp_path / "v"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/v/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(neardup.ORACLE).fetchall()}
    links = sum(n for _, n in want.values())
    monkeypatch.setattr(neardup, "UNIT", 50)  # cells in blocks
    monkeypatch.setattr(neardup, "LOAD", 16)
    got = {r.vec_id: (r.class_id, r.n_links) for r in neardup.near_duplicates(d).collect()}
    assert links > 5000
    assert got.keys() == want.keys()
    assert links >= sum(n for _, n in got.values()) >= 0.98 * links
    assert all(got[k][1] <= want[k][1] for k in want)
    assert sum(got[k][0] == want[k][0] for k in want) >= 0.98 * len(want)


def test_warc_rows(spark, tmp_path):
    rows = [(1, "http://a/x", "<p>é</p>"), (2, None, ""), (None, "u", None), (1, "http://a/x", "<p>é</p>"), (3, "w", "z" * 3_000_000)]
    d = spark.createDataFrame([(*r, "f", 0) for r in rows], "page_id long, url string, html string, file string, record long").repartition(2)
    index = warc.normalised(spark.createDataFrame(warc.monolithic(d, str(tmp_path / "in")).collect(), "file string"), str(tmp_path / "out"))
    got = sorted(map(str, warc.read_back(spark.createDataFrame(index.collect(), index.schema)).collect()))
    assert got == sorted(map(str, d.select("page_id", "url", "html").collect()))
    assert len(list((tmp_path / "out").glob("*.idx"))) == len(list((tmp_path / "out").glob("*.gz")))
    assert not list((tmp_path / "out").glob("*.part"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    key = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert key(got) == key(want)
