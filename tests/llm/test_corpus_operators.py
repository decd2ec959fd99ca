"""Operators over a corpus: language, near copies, licences, the pipeline."""

import pathlib
import random
import re
import textwrap

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from ledgerline.llm import forest, graph, langid, license_scan, quality, secret_scan
from ledgerline.llm.queries import oracle_sql, queries
from ledgerline.llm.shared import BATCH

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"en": "the ing tion and er on th wh re st ea".split(), "de": "der sch ung ein keit ich zu pf ü ß ö".split(), "fr": "le eau eux que é è ment oi ç ai".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    return [(k, prose(rng, lang := ("en", "de", "fr")[k % 3], rng.randint(5, 120)), lang, f"s{k % 2}", 0) for k in range(240)]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, a, s = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.array([0, 4, 4, 5, 9])
    got = langid.marginals(e, first, a, s)
    for b, c in zip(first[:-1], first[1:], strict=True):
        want = np.zeros((c - b, 3))
        for path in np.ndindex(*(3,) * (c - b)):
            p = np.exp(s[path[0]] + sum(e[b + t, y] for t, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:], strict=False))) if c > b else 0
            for t, y in enumerate(path):
                want[t, y] += p
        if c > b:
            assert np.allclose(got[b:c], want / want.sum(1, keepdims=True))


def test_language_on_held_out_documents(spark, labelled):
    odd = [(900, None, "en", "s", 0), (901, "", "de", "s", 0), (902, "12 !? 34", "fr", "s", 0), (None, "the and ing", None, "s", 0), (903, "the wher " * 40000, None, "s", 0)]
    docs = spark.createDataFrame(labelled + odd, SCHEMA).withColumn("score", langid.F.lit("x"))
    got = {r.doc_id: r for r in langid.predicted_folds(docs).collect()}
    import zlib

    right = [got[k].lang_pred == lang for k, _, lang, _, _ in labelled if got[k].held_out]
    assert len(right) > 40 and np.mean(right) > 0.95
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, *_ in labelled)
    assert [(got[k].lang_pred, got[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred == "en" and 0 <= got[903].score <= 1 and got[None].held_out is False
    empty = langid.predicted_folds(docs.limit(0))
    assert empty.count() == 0
    none = langid.predicted_folds(docs.withColumn("lang", langid.F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_the_sample_is_bounded_and_affixes_count(spark, labelled):
    long = "the wher " * 400_000
    rows = [(k, t, lang, s, n) for k, t, lang, s, n in labelled] + [(1000 + k, long + str(k), "en", "s", 0) for k in range(6)] + [(2000 + k, labelled[0][1], "en", "s", 0) for k in range(300)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA).repartition(5), fold=None)
    assert model.labels == ["de", "en", "fr"] and len(langid.passages(long)) <= langid.SLICES * (langid.SLICE + 1)
    assert langid.passages("x" * 10**6).count("x") == langid.SLICES * langid.SLICE and langid.passages("short text") == "short text"
    got = langid.predict_column(model, langid.pa.chunked_array([["the wher", None], ["", "ich der"]]))
    assert got[0] == ["en", "und", "und", "de"] and got[1][1:3] == [0.0, 0.0]
    data, offsets = langid.text_bytes(langid.pa.array(["abcdef", "abcdxx xxcdef ab"]))
    words = langid.word_features(data, offsets)
    assert (words.affixes[0, :3] == words.affixes[1, :3]).all() and (words.affixes[0, 3:] == words.affixes[2, 3:]).all()  # prefixes, suffixes
    assert words.affixes[3, 0] == words.affixes[0, 0] and len(set(words.affixes[3, :3])) == 1


def test_rare_languages_are_learned(spark):
    rng = random.Random(4)
    pools = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(8)] for _ in range(36)]
    say = lambda y: " ".join("".join(rng.choice(pools[y]) for _ in range(rng.randint(1, 3))) for _ in range(30))
    rows = [(100 * y + k, say(y), f"l{y:02}", "s", 0) for y in range(36) for k in range(18 if y < 32 else 9)]
    got = {r.doc_id: r.lang_pred for r in langid.predicted_folds(spark.createDataFrame(rows, SCHEMA)).collect()}
    right = {lang: np.mean([got[k] == lang for k, _, x, *_ in rows if x == lang]) for _, _, lang, *_ in rows}
    assert len(right) == 36 and min(right.values()) > 0.8


def test_code_switched_words(labelled):
    model = langid.train([t for _, t, *_ in labelled], [lang for _, _, lang, *_ in labelled])
    rng = random.Random(8)
    parts = [("en", prose(rng, "en", 30)), ("de", prose(rng, "de", 30)), ("fr", prose(rng, "fr", 30))]
    got = langid.label_words(model, " ".join(t for _, t in parts))
    want = [lang for lang, t in parts for _ in t.split()]
    assert len(got) == len(want) and np.mean([g[1] == w for g, w in zip(got, want, strict=True)]) > 0.9


# -- near copies -------------------------------------------------------------


def shingle_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows):
    """class_id, copy_of and n_links of each row."""
    texts = sorted({t or "" for _, t in rows})
    sets = [shingle_set(t) for t in texts]
    links = {(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        root[find(i)] = find(j)
    least = lambda ks: min((k for k in ks if k is not None), default=None)
    copy = {t: least(k for k, x in rows if (x or "") == t) for t in texts}
    cluster = {i: least(copy[texts[j]] for j in range(len(texts)) if find(j) == find(i)) for i in range(len(texts))}
    return sorted(((k, copy[t or ""], cluster[texts.index(t or "")], sum(texts.index(t or "") in p for p in links)) for k, t in rows), key=str)


def near_corpus(seed=3, groups=12, size=14):
    rng = random.Random(seed)
    rows = [(k, t) for k, t in enumerate([None, "", "one two", "one two", "one  two", " \n ", "a b c d e", "a b c d e f", "x " * 3000])]
    shared = prose(rng, "en", 40)
    for _ in range(groups):
        base = prose(rng, "en", rng.randint(30, 150)).split()
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(["zip", "zap", "zop"])
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), rows[-1][1]))
    rows += [(len(rows) + k, f"{shared} {prose(rng, 'de', 60)}") for k in range(20)]
    return rows + [(None, rows[20][1]), rows[25]]


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 6)  # many blocks
    rows = near_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", forest.F.lit(1)).withColumn("class_id", forest.F.lit(2))
    got = sorted(((r.doc_id, r.copy_of, r.class_id, r.n_links) for r in forest.jaccard_join(docs).collect()), key=str)
    assert got == brute(rows)
    assert forest.jaccard_join(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [256, 3])
def test_one_document_of_each_class_stays(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "BLOCK", block)
    rows = near_corpus(groups=4) + [(None, "only null keys here now"), (None, "only null keys here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", forest.F.lit(1))
    kept = forest.keep_one(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    want = {x[2] for x in brute(rows)}
    assert len(got) == len(set(got)) and set(got) == want


def test_prefixes_shorten_to_the_recall():
    assert forest.prefix_length(0.8, 0.5) > forest.prefix_length(0.8, 0.9995) >= 1
    k = forest.prefix_length(0.8, 0.9995)
    assert 1 - (1 - 0.8**k) ** forest.TREES >= 0.9995 > 1 - (1 - 0.8 ** (k + 1)) ** forest.TREES
    stops = forest.stop_lengths(0.8, 0.9995, 40)
    assert stops[1:4].tolist() == [forest.LABEL] * 3  # nothing but an equal set is as similar
    for n in range(1, 40):
        least = min(i / (n + m - i) for m in range(1, 80) for i in range(1, min(n, m) + 1) if 10 * i >= 8 * (n + m - i))
        assert stops[n] == forest.prefix_length(least, 0.9995)
    assert stops[-1] == k == stops.min()


def test_recall_of_planted_pairs(spark):
    """Pairs just at the threshold, each in a class of its own."""
    rng = random.Random(12)
    rows, want = [], 0
    for k in range(150):
        words = [f"{rng.randrange(10**6)}x{j}" for j in range(94)]
        other = list(words)
        at = rng.randrange(10, 40)
        other[at] = other[at + 45] = "new"  # 10 of 90 shingles differ: 80 of 100 are shared
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.class_id for r in forest.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(150)) >= 149


@pytest.mark.parametrize("counted", [True, False])
def test_chains_meet_in_their_nodes(spark, monkeypatch, counted):
    """A chain of texts, each close to the next alone, has few pairs in its nodes."""
    monkeypatch.setattr(forest, "BLOCK", 8)
    words = [f"w{k}" for k in range(1200)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 80])) for k in range(200)]
    seen = []
    plain = forest.meetings
    monkeypatch.setattr(forest, "meetings", lambda *a: (seen.append(plain(*a)), seen[-1])[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if counted:
        got = sorted(((r.doc_id, r.copy_of, r.class_id, r.n_links) for r in forest.jaccard_join(docs).collect()), key=str)
        assert got == brute(rows)
    else:
        assert [r.doc_id for r in forest.keep_one(docs).collect()] == [0]
    assert seen[0].where("tree >= 0").count() > 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(a, a + 1) for a in range(60) if a % 20 != 19] + [(100, rng.randrange(101, 140)) for _ in range(60)] + [(7, 7), (3, 4), (None, 1)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == n // 20 * 20 for n in range(60)) and all(v == 100 for k, v in got.items() if k >= 100)


# -- licences ----------------------------------------------------------------


def license_rows():
    mit = license_scan.KNOWN["MIT"]
    messy = "Copyright (c) 2020 Someone\n" + mit.upper().replace(". ", ".\n\n   ").replace('"', "“") + "\n(c) 2021 Other"
    isc = license_scan.KNOWN["BSL-1.0"].replace("license", "licence")
    wrapped = []
    for width in range(40, 101, 3):
        for k, (name, text) in enumerate(license_scan.forms()):
            if (width + k) % 4 == 0:
                lines = [line for p in text.split("\n") for line in (textwrap.wrap(p, width) or [""])]
                mark = ("", "# ", " * ", "// ", "")[(width + k) % 5]
                head = ("", "Copyright (c) 2020, A. Holder\nAll rights reserved.\n\n", "(c) 2021 Somebody\n", "Copyright 1999-2003 The Authors\n")[k % 4]
                wrapped.append((1000 + len(wrapped), "\n".join(mark + line for line in (head + "\n".join(lines)).split("\n")), name))
    assert len(wrapped) > 100
    license_rows.wrapped = {k: name for k, _, name in wrapped}
    return [(k, t) for k, t, _ in wrapped] + [(20, mit.replace("License", "Licence").replace("sublicense", "sub licence").replace("noninfringement", "non-infringement")), (23, mit.replace("License", "Licence").replace("sublicense", "sublicence")), (24, "The MIT License\n\nCopyright (c) 2001 X\nAll rights reserved.\n" + mit.split("\n\n", 1)[1]), (21, "licence licence licence"), (22, "license licence license"), (1, mit), (2, messy), (3, mit + " and more"), (4, None), (5, ""), (6, "?!"), (7, isc), (7, isc), (None, license_scan.KNOWN["Zlib"]), (8, "x " * 50000), (9, license_scan.KNOWN["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "))]


def test_licences_and_their_sql(spark):
    docs = spark.createDataFrame(license_rows(), "doc_id long, text string").withColumn("license_id", license_scan.F.lit("x"))
    got = [(r.doc_id, r.canonical_sha256, r.canonical_chars, r.license_id) for r in license_scan.lookup(docs).select("doc_id", "canonical_sha256", "canonical_chars", "license_id").collect()]
    assert {k: i for k, _, _, i in got if (k or 0) >= 1000} == license_rows.wrapped
    assert len({d for k, d, _, _ in got if k in (21, 22)}) == 1
    got_all, got = got, [r for r in got if (r[0] or 0) < 1000]
    assert {(k, i) for k, _, _, i in got} == {(20, "MIT"), (23, "MIT"), (24, "MIT"), (21, None), (22, None), (1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (7, "BSL-1.0"), (None, "Zlib"), (8, None), (9, "BSD-3-Clause")}
    assert len(got) == 16 and license_scan.known_digests(docs).count() > 2 * len(license_scan.KNOWN)
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", license_rows())
    assert sorted(base.sql(oracle_sql()["op6_license_digests"]).fetchall(), key=str) == sorted(got_all, key=str)
    assert license_scan.lookup(docs.limit(0)).count() == 0


PUBLISHED = pathlib.Path("/usr/share/common-licenses")


@pytest.mark.skipif(not PUBLISHED.is_dir(), reason="no published texts on this machine")
def test_long_licences_wrapped_and_cut(spark):
    def wrapped(text, width):
        # lines that say whose the text is stay lines
        keep = lambda p: "opyright (" in p and len(p) < 420
        return "\n\n".join(p if keep(p) else "\n".join(textwrap.wrap(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False)) for p in text.split("\n\n"))

    files = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    rows = []
    for file, name in files.items():
        whole = (PUBLISHED / file).read_text()
        cut = whole.split("END OF TERMS AND CONDITIONS")[0] + ("END OF TERMS AND CONDITIONS" if "END OF TERMS" in whole else "")
        for text in (whole, cut, cut.upper(), whole.replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301", "59 Temple Place, Suite 330, Boston, MA  02111-1307"), *(wrapped(cut, w) for w in range(54, 100, 5))):
            rows += [(len(rows), text, name), (len(rows) + 1, re.sub("(?i)shall|may", "will", text), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, wanted string")
    got = {r.doc_id: r.license_id for r in license_scan.lookup(docs).collect()}
    assert got == {k: name for k, _, name in rows} and set(files.values()) < set(license_scan.LONG)


# -- pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark, labelled, tmp_path):
    rng = random.Random(6)
    rows = [(k, t + " " + prose(rng, lang, 30), lang, s, 0) for k, t, lang, s, _ in labelled[:90]]
    rows += [(500, rows[0][1], "en", "s0", 0), (501, rows[3][1] + " x7", "en", "s0", 0), (502, "12 34 " * 30, "en", "s0", 0), (503, rows[6][1] + "\npassword = x7Gq2LmPz9Wd7", "en", "s0", 0), (504, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    language, good, single, masked = ({r.doc_id: r.text for r in d.collect()} for d in seen[1:])
    assert not {502, 504} & set(language) and len(language) == len(rows) - 2
    kept = {r.doc_id for r in quality.judged(seen[1]).collect() if r.kept}
    assert set(good) == kept
    assert set(single) == {x[2] for x in brute(list(good.items()))} and 500 not in single
    assert masked == {k: secret_scan.redact(t) for k, t in single.items()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen[-1], str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(masked)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_copies", "secrets", "packing"]


@pytest.mark.parametrize("name", ["op9_jaccard_forest", "op10_adaptive_quality"])
@pytest.mark.parametrize("rows", ["near", "labelled", "table"])
def test_queries_equal_their_sql(spark, labelled, tmp_path, name, rows):
    folder = "/root/testdata/sf0.001"
    if rows != "table":
        folder = str(tmp_path)
        made = [(k, t, "en", None, 0) for k, t in near_corpus()] if rows == "near" else labelled + [(None, None, None, None, None), (900, labelled[0][1] + " # " * 90, "en", "s0", 0)]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{'' if rows == 'table' else '/*.parquet'}')")
    wanted = base.sql(oracle_sql()[name])
    got = queries()[name](spark, folder)
    assert sorted(map(str, map(tuple, got.select(*wanted.columns).collect()))) == sorted(map(str, wanted.fetchall())) and set(got.columns) == set(wanted.columns)


def test_every_operator_is_registered():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{k}" for k in range(1, 11)), "pipeline"]


def test_stages_take_texts_in_small_batches(spark):
    docs = spark.createDataFrame([(1, "some words " * 30, "en", "a", 330)], "doc_id long, text string, lang string, source string, n_chars long")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches)
    rows = spark.range(0, 5000, 1, 1).selectExpr("repeat('x', 1000) AS text")
    try:
        for name, stage in corpus_pipeline.STAGES:
            for conf in BATCH:
                spark.conf.unset(conf)
            stage(spark, docs, "")
            got = rows.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in got) == 5000 and max(r.n for r in got) <= 2000, name
    finally:
        for conf in BATCH:
            spark.conf.unset(conf)
