"""Defined cases of the corpus operators and stages: values on nulls, large ids, repeated rows, clashing names, empty tables, long texts."""

import hashlib

import pytest

from quarry.llm import decontamination, html_text, license_scan, mixing, near_duplicates, quality_classifier, quality_rules, queries, secrets_scan, token_counts, toxicity
from quarry.llm.common import scratch

SF = "/root/testdata/sf0.001"
BIG = (1 << 60) + 1
#: Columns with the operators' own names beside those of documents.
DOC = "doc_id long, text string, lang string, source string, n_chars long, _words string, _clean boolean, content string, quality_score double, score int, n_tokens string, _tokens string, _source string, row string, k0 string, id long, bands string, predicted int, topic_class string"
OWN = ("w", True, "c", 0.25, 7, "n", "t", "s", "r", "k", 5, "b", 3, "top")
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
SECRET = "password = hunter2hunter2"


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
    return [
        (BIG, "some other words here in a row", "en", "a", 30),
        (None, "some words here", None, None, None),
        (BIG + 1, None, "en", "a", 0),
        (BIG + 2, "", "en", "a", 0),
        (3, long, "de", "b", len(long)),
        (4, "tie tie tie", "en", "a", 11),
        (4, "tie tie tie", "en", "a", 11),
        (5, f"{SECRET} {ITEM}", "fr", "b", 99),
    ]


@pytest.fixture(scope="module")
def odd(spark, rows):
    return spark.createDataFrame([(*r, *OWN) for r in rows], DOC)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(BIG, ITEM, 1), (BIG, ITEM, 1), (None, "some words here", 2), (8, None, 3), (9, "", 4), (10, "hunter2hunter2", 5), (11, "tie tie", 6)], "item_id long, text string, doc_id int")


@pytest.fixture(scope="module")
def labels(spark):
    good = [(BIG, 1, 0), (3, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1), (5, None, None)]
    return spark.createDataFrame(good, "doc_id long, quality int, toxic int")


def by_id(df, *cols):
    return sorted(((r.doc_id, *(r[c] for c in cols)) for r in df.collect()), key=repr)


def ids(rows):
    return sorted((r[0] for r in rows), key=repr)


def test_decontamination_cases(odd, benchmark):
    got = by_id(decontamination.contamination(odd, benchmark), "item_id", "n_edits", "first_word")
    want = [(4, 11, 0, 0)] * 2 + [(5, 10, 0, 1)] + [(5, BIG, 0, 2)] * 2
    assert got == sorted(want, key=repr)
    left = decontamination.decontaminate(odd, benchmark)
    assert left.columns == odd.columns and [tuple(r)[5:] for r in left.collect()] == [OWN] * 5
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([BIG, None, BIG + 1, BIG + 2, 3], key=repr)
    assert decontamination.contamination(odd, benchmark.limit(0)).count() == 0 == decontamination.contamination(odd.limit(0), benchmark).count()
    assert decontamination.decontaminate(odd, benchmark.limit(0)).count() == 8


def test_near_duplicate_cases(spark, odd, rows):
    got = by_id(near_duplicates.near_duplicates(odd), "class_id", "n_class")
    want = [(BIG, BIG, 1), (None, None, 1), (BIG + 1, BIG + 1, 2), (BIG + 2, BIG + 1, 2), (3, 3, 1), (4, 4, 2), (4, 4, 2), (5, 5, 1)]
    assert got == sorted(want, key=repr)
    left = near_duplicates.keep_one(odd)
    assert left.columns == odd.columns and all(tuple(r)[5:] == OWN for r in left.collect())
    assert ids(left.collect()) == sorted([BIG, None, BIG + 1, 3, 4, 5], key=repr)
    # Equal ids with different texts, a copy under a kept id, a copy without an id.
    d = spark.createDataFrame([(3, "one text of five words"), (5, "one text of five words"), (5, "quite another text this is"), (None, "quite another text this is"), (None, "x"), (None, "x")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates.keep_one(d).collect()), key=repr) == sorted([(3, "one text of five words"), (5, "quite another text this is"), (None, "x")], key=repr)
    assert near_duplicates.keep_one(odd.limit(0)).count() == 0 == near_duplicates.near_duplicates(odd.limit(0)).count()


def test_html_cases(spark):
    page = "<article><p>a b</p></article><nav>no</nav>"
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    d = spark.createDataFrame([(BIG, "http://h/1", page, 1, "t"), (None, None, None, 1, "t"), (BIG, "http://h/1", page, 1, "t"), (2, "", "", 1, "t"), (3, "x", deep, 1, "t")], "page_id long, url string, html string, key int, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(d).collect()), key=repr)
    assert got == sorted([(BIG, "http://h/1", "a b", 3)] * 2 + [(None, None, "", 0), (2, "", "", 0), (3, "x", "deep", 4)], key=repr)
    assert html_text.extract(d.limit(0)).count() == 0


def test_html_keeps_the_article():
    t = html_text.main_text
    assert t("<main><article><p>one</article><article><p>two</article><p>tail</main>") == "one two tail"
    assert t("<article><p>one</article><div>x</div><article><p>two</article>") == "one two"
    assert t('<p class="share-price">Price 5</p><p class="ad">buy</p><div class="share-buttons">x</div><div class="shares-outstanding">keep</div>') == "Price 5 keep"
    assert t("<p title=it's>hello <b>x</b></p><p>more it's</p>") == "hello x more it's"
    assert t('<p class="a>lost <p class="b">kept</p>') == "lost kept" and t('<p title="a > b">y</p>') == "y"
    assert t("&<b>amp;</b>lt; &amp;lt;") == "&amp;lt; &lt;"


def test_secret_cases(spark, odd, rows):
    got = by_id(secrets_scan.secret_digest(odd), "n_assign", "spans")
    assert got == sorted([(r[0], *((1, "assign:0:25") if r[0] == 5 else (0, ""))) for r in rows], key=repr)
    out = secrets_scan.redact(odd)
    assert out.columns == odd.columns
    text = {(r.doc_id, r.text, tuple(r)[5:]) for r in out.collect()}
    assert text == {(r[0], f"password = [SECRET] {ITEM}" if r[0] == 5 else r[1], OWN) for r in rows}
    assert secrets_scan.secret_digest(odd.limit(0)).count() == 0 == secrets_scan.redact(odd.limit(0)).count()
    assert secrets_scan.secret_digest(odd.limit(0).unionByName(odd.filter("doc_id = 4"))).first().base_sha256 == hashlib.sha256(b"").hexdigest()


def test_secret_formats_are_found_without_their_assignment(spark):
    import random

    r = random.Random(3)
    key = lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(i, f"the key is token={key()} indeed") for i in range(60)] + [(100 + i, f"commit {h} of the branch") for i, h in enumerate(hexes)]
    rows += [(200 + i, " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 11))) for _ in range(40))) for i in range(200)]
    loose = "".join(r.choice("0123456789abcdef") for _ in range(22))  # too short for the base pattern
    rows += [(999, f"then {loose} stood alone and internationalization2 too")]
    got = {x.doc_id: x for x in secrets_scan.secret_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[999].spans == "format:5:27" and got[999].n_hex == 0
    assert all(got[i].n_format == 0 for i in range(200, 400))


def _random_text(r, alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(n))


def test_automaton_keeps_length_and_order(spark):
    """Held-out keys are found; other lengths, shuffled keys and ordinary identifiers are not."""
    import random

    r = random.Random(11)
    digits, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: _random_text(r, "etaoinshrdlucmfwyp", r.randint(4, 11))
    plain = secrets_scan.PrefixTree([word() for _ in range(4000)]).merged()
    share = lambda f, tokens: sum(f.kind_of(t) is not None for t in tokens) / len(tokens)
    ordinary = [f"{word()}{r.randint(1, 9999)}" for _ in range(400)] + [f"{word()}_{word()}.v{r.randint(1, 99)}" for _ in range(400)]
    ordinary += ["-".join(_random_text(r, digits, n) for n in (8, 4, 4, 4, 12)) for _ in range(400)]
    for count in (60, 130, 1500):
        hexes = secrets_scan.PrefixTree([_random_text(r, digits, 40) for _ in range(count)]).merged()
        assert len(hexes.ends) == 41 and hexes.ends[40] > 0.99 > 0.01 > max(hexes.ends[:40])
        f = secrets_scan.Formats({"hex": hexes}, plain, {"hex": 0.7})
        assert share(f, [_random_text(r, digits, 40) for _ in range(400)]) >= 0.95
        assert share(f, [_random_text(r, digits, n) for n in range(8, 13) for _ in range(200)]) < 0.01 > share(f, [t for t in ordinary if len(t) >= 8])
    access = secrets_scan.PrefixTree(["AKIA" + _random_text(r, upper, 16) for _ in range(100)]).merged()
    f = secrets_scan.Formats({"access": access}, plain, {"access": 0.8})
    assert share(f, ["AKIA" + _random_text(r, upper, 16) for _ in range(400)]) >= 0.95
    assert share(f, [_random_text(r, upper, 20) for _ in range(400)] + [_random_text(r, upper, 16) + "AKIA" for _ in range(400)]) < 0.01


def test_automaton_likelihood_is_that_of_counted_steps():
    """Tokens of one length whose positions are independent: bits by hand from counts at each position."""
    import math

    tokens = ["a1", "a2", "b1", "a1", "b2", "a3"] * 20
    got = secrets_scan.PrefixTree(tokens).merged()
    n, unseen = len(tokens), secrets_scan.UNSEEN
    step = (n + unseen) / (n + unseen * (len(secrets_scan.SIZE) + 1))
    char = lambda at, c: (sum(t[at] == c for t in tokens) + 1) / (n + {0: 6, 1: 10}[at])
    for token in ("a1", "b3", "a9"):
        assert math.isclose(got.bits(token), -math.log2(step * char(0, token[0]) * step * char(1, token[1]) * step))
    repeated = secrets_scan.PrefixTree(["ab" * r for r in range(1, 30) for _ in range(max(1, 2000 // 2**r))]).merged()
    assert len(repeated.ends) < 58  # states of different depths are one where lengths are spread evenly


def test_learned_formats_refuse_other_lengths_and_identifiers(spark):
    import random

    r = random.Random(13)
    digits, letters = "0123456789abcdef", "etaoinshrdlucmfwyp"
    sentence = lambda: " ".join(_random_text(r, letters, r.randint(4, 11)) for _ in range(30))
    key = lambda: "gk_" + _random_text(r, digits, 24)[:21] + "Z"
    rows = [(i, f"{sentence()} token={key()} then") for i in range(80)] + [(100 + i, sentence()) for i in range(200)]
    loose, short, other = key(), key()[:11], "-".join(_random_text(r, digits, n) for n in (8, 4, 4, 4, 12))
    rows += [(900, f"use {loose} here"), (901, f"use {short} here"), (902, f"use {other} here"), (903, f"release {_random_text(r, digits, 7)}9 of user12345678")]
    got = {x.doc_id: x for x in secrets_scan.secret_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[900].spans == f"format:4:{4 + len(loose)}"
    assert [got[i].spans for i in (901, 902, 903)] == ["", "", ""] and all(got[100 + i].spans == "" for i in range(200))


def test_quality_classifier_cases(odd, rows, labels):
    got = quality_classifier.quality_scores(odd, labels)
    assert ids(got.collect()) == ids(rows) and {r.held_out for r in got.collect()} <= {True, False}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.collect())
    none = quality_classifier.quality_scores(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and len(none) == 8
    model = quality_classifier.train(odd, labels)
    out = quality_classifier.score(odd, model)
    assert sorted(out.columns) == sorted([*odd.columns, "quality_predicted"]) and all(r.quality_score != 0.25 for r in out.collect())
    assert quality_classifier.keep_good(odd, model).columns == odd.columns
    assert quality_classifier.quality_scores(odd.limit(0), labels).count() == 0


def test_toxicity_cases(odd, rows, labels):
    got = toxicity.toxicity_scores(odd, labels)
    assert ids(got.collect()) == ids(rows) and all(0 <= r.score <= 1 for r in got.collect())
    none = toxicity.toxicity_scores(odd, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1 and len(none) == 8
    assert toxicity.toxicity_scores(odd.limit(0), labels).count() == 0


def test_all_maximal_segments_are_found():
    """Against the definition: recursively, the best segment (shortest, then first), and those left and right of it."""
    import random

    def brute(s, at=0):
        best = max(((round(sum(s[i:j]), 9), i - j, -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, _, i, j = best
        return [*brute(s[:i], at), (at + i, at + j, best[0]), *brute(s[j:], at + j)]

    r = random.Random(4)
    for _ in range(300):
        s = [r.choice([-0.37, -0.37, -0.37, 2.03, 1.01, 0.13]) for _ in range(r.randint(1, 24))]
        got = toxicity.segments([(i, x) for i, x in enumerate(s) if x > 0], len(s), -0.37)
        assert [(a, b, round(x, 6)) for a, b, x in got] == [(a, b, round(x, 6)) for a, b, x in brute(s)]


def test_rules_tokens_licenses_and_mixing_cases(odd, rows):
    assert ids(quality_rules.quality_rules(odd).collect()) == ids(rows)
    n = {(r.doc_id, r.n_bytes) for r in token_counts.token_counts(odd).collect()}
    assert n == {(r[0], len((r[1] or "").encode())) for r in rows}
    assert ids(license_scan.license_scan(odd).collect()) == ids(rows)
    out = mixing.mix(odd)
    assert ids(out.collect()) == ids(rows) and sorted(out.columns) == sorted({*odd.columns, *mixing.RESULTS})
    assert {r._tokens for r in out.collect()} == {"t"} and {r.topic_class for r in out.collect()} == {"size:short", "size:long"}
    for f in (quality_rules.quality_rules, token_counts.token_counts, license_scan.license_scan, mixing.mix):
        assert f(odd.limit(0)).count() == 0


def test_related_licenses_are_told_apart(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
    rows = [(1, gpl.format("")), (2, gpl.format("Lesser ")), (3, gpl.format("Affero ")), (4, cc.format("")), (5, cc.format("-ShareAlike")), (6, "free software you can redistribute it and or modify it under the terms of the " + "other words " * 40 + " General Public License as published by the Free Software Foundation")]
    got = {r.doc_id: (r.labels, r.passages) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "gpl", 2: "lgpl", 3: "agpl", 4: "cc-by", 5: "cc-by-sa", 6: ""}
    assert got[1][1] == "gpl:0:29"


def test_mixing_is_the_raking_of_an_independent_program(spark):
    """Shares against a plain loop over the cells; the draw against the hash it is made of."""
    import pandas as pd

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = mixing.mix(docs).toPandas()
    cells = r.groupby(["source", "lang", "topic_class"]).agg(t=("n_tokens", "sum"), s=("cell_share", "first"), k=("keep_probability", "first")).reset_index()
    target = {m: (p := cells.groupby(m).t.sum() ** mixing.TEMPER) / p.sum() for m in ("source", "lang", "topic_class")}
    x = cells.t / cells.t.sum()
    for _ in range(mixing.ROUNDS):
        for m, t in target.items():
            x = x * cells[m].map(t) / x.groupby(cells[m]).transform("sum")
    assert (x - cells.s).abs().max() < 1e-5
    lift = cells.s * cells.t.sum() / cells.t
    free = cells.k < 1
    assert ((cells.k / lift)[free].max() - (cells.k / lift)[free].min()) < 1e-9
    unit = pd.Series([int(hashlib.md5(f"{d}\u0001{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 16**13 for d, t in zip(r.doc_id, r.text)])
    assert (r.sampled == (unit < r.keep_probability)).all()


@pytest.mark.parametrize("stage", [queries.stage_quality, queries.stage_near_duplicates, queries.stage_decontamination, queries.stage_secrets, queries.stage_mixing])
def test_stages_pass_odd_rows(spark, odd, rows, stage, tmp_path, labels, benchmark):
    """With the tables of the query, with odd tables and with empty ones."""
    labels.write.parquet(str(tmp_path / "odd/labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "odd/benchmark.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "none/labels.parquet"))
    benchmark.limit(0).write.parquet(str(tmp_path / "none/benchmark.parquet"))
    for d in (SF, str(tmp_path / "odd"), str(tmp_path / "none")):
        out = stage(spark, odd, d)
        kept = [tuple(r[c] for c in odd.columns if c not in ("text", "n_chars", *mixing.RESULTS)) for r in out.collect()]
        every = [tuple(r[c] for c in odd.columns if c not in ("text", "n_chars", *mixing.RESULTS)) for r in odd.collect()]
        assert all(every.count(k) >= kept.count(k) for k in kept)
        if stage is queries.stage_secrets:
            assert sorted(map(repr, kept)) == sorted(map(repr, every))
            assert {r.n_chars for r in out.filter("doc_id = 5").collect()} == {len(f"password = [SECRET] {ITEM}")}
        assert stage(spark, odd.limit(0), d).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, k, d=None: d})()

    with pytest.raises(ValueError):
        scratch(Session())


def test_topics_follow_the_words_and_not_the_size(spark, monkeypatch):
    """Three vocabularies: no topic mixes them, whatever the length of a text; a text without a known word says so."""
    import random

    r = random.Random(3)
    words = {v: [f"{v}{c}{d}" for c in "abcde" for d in "fghij"] for v in ("plant", "metal", "river")}
    rows = [(i, " ".join(r.choice(words[v]) for _ in range(20 if i % 2 else 400)), "en", "s") for i, v in enumerate(list(words) * 40)]
    docs = spark.createDataFrame([*rows, (1000, None, None, None), (1001, "unheard", "en", "s")], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(mixing, "rake", lambda cells, targets: cells.selectExpr("*", "0.1D AS share"))  # the topics are all that is looked at
    got = {x.doc_id: x.topic_class for x in mixing.mix(docs, topic=mixing.topics(docs)).collect()}
    assert got[1000] == got[1001] == "topic:none"
    groups = [{got[i] for i in range(120) if i % 3 == v} for v in range(3)]
    assert not groups[0] & groups[1] and not groups[0] & groups[2] and not groups[1] & groups[2] and "topic:none" not in set.union(*groups)
    assert {x.topic_class[:6] for x in queries.op8_mixing(spark, SF).select("topic_class").distinct().collect()} == {"topic:"}


def test_the_pipelines_mixing_meets_its_margins_however_many_rounds_it_takes(spark, monkeypatch):
    """Topics that nearly follow the languages: the cells between them are small and must grow a thousandfold."""
    from pyspark.sql import functions as F

    words = [("l0", "t0", 1000, 20), ("l0", "t1", 1000, 20), ("l1", "t2", 1000, 20), ("l1", "t0", 3, 1), ("l0", "t2", 3, 1)]
    rows = [(1000 * k + i, "w " * n, lang, topic, 2 * n) for k, (lang, topic, n, many) in enumerate(words) for i in range(many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(mixing, "topics", lambda d: F.col("source"))
    share = {(r.lang, r.topic_class): r.cell_share for r in queries.stage_mixing(spark, docs, SF).collect()}
    assert {("l0", "t0"), ("l0", "t1"), ("l1", "t2"), ("l1", "t0")} <= set(share)  # ("l0", "t2") shrinks to almost nothing
    for at, names in ((0, ("l0", "l1")), (1, ("t0", "t1", "t2"))):
        p = {v: sum(w[2] * w[3] for w in words if w[at] == v) ** mixing.TEMPER for v in names}
        for v in names:
            assert abs(sum(s for k, s in share.items() if k[at] == v) - p[v] / sum(p.values())) < 1e-5
