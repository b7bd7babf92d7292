"""Spelling variants, the Jaccard join and the filter audit against brute force, and their defined cases."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import filter_audit, hashing, jaccard_join, queries, spelling_variants

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, n int, words string, id long, key string, part string, mask string, k0 string, row string, quality int, run string"
OWN = (1, "w", 7, "k", "p", "m", "k0", "r", 1, "x")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LABELS = "doc_id long, quality int, toxic int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, *OWN) for i, t, s in rows], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_are_hashed_alike_in_any_block(monkeypatch):
    rnd, known = random.Random(1), {}
    for block in (7, 64, 1 << 20):
        monkeypatch.setattr(hashing, "BLOCK", block)
        for _ in range(40):
            texts = [rnd.choice([None, "", "".join(rnd.choice("aAbB é\n\t  zZx") for _ in range(rnd.randint(0, 60)))]) for _ in range(9)]
            got = hashing.ascii_words(pa.array(["xx y", *texts])[1:])
            want = [[w.translate(UP) for w in words(t)] for t in texts]
            assert [len(g) for g in got] == [len(w) for w in want]
            for g, ws in zip(got, want):
                assert all(known.setdefault(w, h) == h for h, w in zip(g.tolist(), ws))
    assert len(set(known.values())) == len(known)


# Spelling variants.


def variants(rows, every=199):
    n = collections.Counter()
    for i, text, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(UP)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % every else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    by = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(by[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(by[w]), n[form[w]] if form[w] else None) for w in n}


def found_variants(df, every=199):
    return {tuple(r) for r in spelling_variants.spelling_variants(df, every).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_are_those_of_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, None) for r in docs.select("doc_id", "text").collect()]
    assert found_variants(docs) == variants(rows)


@pytest.mark.parametrize("least", [2, 16])
def test_variants_of_repetitive_and_hot_words(spark, monkeypatch, least):
    """Words of repeated grams, a prefix that all words share, chains of forms; with much and little lengthening of grams."""
    monkeypatch.setattr(spelling_variants, "LEAST", least)
    rnd = random.Random(least)
    made = ["abcabcabc", "abcabcabcabc", "abcabcabcab", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "straße", "straßen", "señora×", "Éclairs", "éclairs"]
    made += ["commonword" + "".join(rnd.choice("ab") for _ in range(5)) for _ in range(60)]
    for w in list(made):
        i = rnd.randrange(len(w))
        made += [w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :]]
    rows = [(d, " ".join(w for w in made for _ in range(rnd.choice([1, 2, 6, 30, 200]))), "s") for d in range(3)]
    rows += [(None, "alonely alonely ALONELY Alonely alonely", "s"), (9, None, None), (9, "", None), (10, "short " * 9, None)] + [(11, "repeatedrow", "s")] * 5
    assert found_variants(table(spark, rows), 7) == variants(rows, 7)
    assert spelling_variants.spelling_variants(table(spark, [])).count() == 0


# The Jaccard join.


def joined(rows):
    sets = []
    for _, text, _ in rows:
        w = [x.translate(UP) for x in words(text)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(rows)))

    def of(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            top[of(i)] = of(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[of(i)] = min([x for x in (d, least.get(of(i))) if x is not None], default=None)
    return sorted(((d, len(s), least[of(i)]) for i, ((d, _, _), s) in enumerate(zip(rows, sets))), key=repr)


def components_of(df):
    return sorted((tuple(r) for r in jaccard_join.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_bounds_hold_for_all_sizes():
    for n in range(1, 400):
        for m in range(n, jaccard_join.largest(n) + 1):
            most = max((n + m - 2 * i for i in range(n + 1) if 100 * i >= 80 * (n + m - i)), default=None)
            if most is None:
                continue
            assert most <= jaccard_join.allowed(n, m)
            shared = dict(jaccard_join.bands(n)).keys() & dict(jaccard_join.bands(m)).keys()
            assert shared  # they meet in a band, with enough keys on both sides
            assert any(min(dict(jaccard_join.bands(n))[b], dict(jaccard_join.bands(m))[b]) > most for b in shared)
            assert all(jaccard_join.segments(b) >= dict(jaccard_join.bands(m))[b] for b in dict(jaccard_join.bands(m)))


def test_sketches_bound_the_difference():
    rnd = np.random.default_rng(1)
    for n in (1, 5, 40, 63, 64, 200):
        s = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        t = np.unique(np.r_[s[: int(n * 0.9)], rnd.integers(0, 1 << 63, n // 10 + 1).astype(np.uint64)])
        diff = len(np.setxor1d(s, t))
        for b in {b for b, _ in jaccard_join.bands(n)}:
            assert (jaccard_join.segment_keys(s, b)[0] != jaccard_join.segment_keys(t, b)[0]).sum() <= diff
        a, b = jaccard_join.dense(s), jaccard_join.dense(t)
        a, b = (a[: len(a) // 2] ^ a[len(a) // 2 :], b) if len(a) > len(b) else (a, b[: len(b) // 2] ^ b[len(b) // 2 :]) if len(b) > len(a) else (a, b)
        assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= diff


def test_join_is_that_of_all_pairs(spark, monkeypatch):
    """Edits about the limit at many sizes, a group of near copies, a passage that many texts share, copies, tiny and odd texts."""
    monkeypatch.setattr(jaccard_join, "PAIRED", 6)
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    rnd, rows = random.Random(3), []
    text = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    for n in (4, 5, 6, 7, 8, 9, 12, 16, 31, 33, 60, 64, 70, 127, 130, 300):
        base = text(n)
        for edits in (0, 1, 1, max(1, n // 60), n // 45, n // 40, n // 36):
            t = list(base)
            for _ in range(edits):
                t[rnd.randrange(len(t))] = f"x{rnd.randrange(99999)}"
            rows.append((len(rows), " ".join(t[: len(t) - rnd.choice([0, 0, 1, n // 12])]).upper() if rnd.random() < 0.2 else " ".join(t), "s"))
    group, passage = text(90), text(70)
    for _ in range(70):
        t = list(group)
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(len(t))] = f"y{rnd.randrange(99999)}"
        rows.append((len(rows), "\t".join(t), "s"))
    for _ in range(60):
        rows.append((len(rows), "\n".join([*text(rnd.randrange(8, 60)), *passage]), "t"))
    rows += [(1000, None, None), (1001, "", None), (1002, " \n\t", None), (1003, "one", None), (1004, "ONE", None), (1005, "one two three four", None), (None, "One two THREE four", None), (None, "no id at all here it is", None)]
    rows += [(1006, "said twice in two equal rows", None)] * 2 + [(1007, "É É É É É", None), (1008, "é é é é é", None)]
    assert components_of(table(spark, rows)) == joined(rows)


def test_join_without_links_and_of_nothing(spark):
    rows = [(i, " ".join(f"{i}-{j}" for j in range(30)), "s") for i in range(5)]
    assert components_of(table(spark, rows)) == joined(rows)
    assert components_of(table(spark, [])) == []
    long = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
    assert components_of(table(spark, [(2, long, "s"), (1, long + " end", "s")])) == joined([(2, long, "s"), (1, long + " end", "s")])


# The filter audit.


def audited(rows, labels):
    first, by, out = {}, {}, {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, s in rows:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        own = [x for x in labels if x[0] == i and i is not None]
        by.setdefault(s or "", []).append((fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    for part, docs in by.items():
        total = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [True] * len(docs)
            for step, f in enumerate(order, 1):
                c = collections.Counter()
                for k, (fails, good, toxic) in enumerate(docs):
                    c["unique"] += fails[f] and sum(fails.values()) == 1
                    c["redundant"] += fails[f] and not left[k]
                    if fails[f] and left[k]:
                        left[k] = False
                        c["removed"] += 1
                        c["good"] += good
                        c["toxic"] += toxic
                total[f] += c["removed"]
                out[part, order, step] = [sum(left), c["removed"], c["redundant"], c["unique"], c["good"], c["toxic"], f]
        for (p, _, _), v in out.items():
            if p == part:
                v[-1] = total[v[-1]]
    return sorted((*k, *v) for k, v in out.items())


def test_audit_is_that_of_each_order(spark):
    many = " ".join(f"w{i}" for i in range(250))
    texts = [many, many + " #", many.upper(), "a " * 300, "A* " * 300, "few words", "few words", "", None, many + " Z", "SHOUT " * 40]
    rows = [(i, texts[i % len(texts)], [None, "", "s", "t"][i % 4]) for i in range(70)]
    rows += [(3, many, "u")] * 3 + [(None, many, "s"), (None, many, "s"), (90, many, "a part")]
    labels = [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 70, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (6, None, None), (500, 1, 1)]
    labels = [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in labels]
    got = filter_audit.filter_audit(table(spark, rows), spark.createDataFrame(labels, LABELS))
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == audited(rows, labels)
    assert filter_audit.filter_audit(table(spark, []), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("name", ["op12_jaccard_join", "op13_filter_audit"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF).select(*rel.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


# What earlier operators were mended for.


def page_rows(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_pages_in_a_form_keep_their_text():
    from quarry.llm import html_text

    story = "<p>" + "The story goes on and on with many words. " * 8 + "</p>"
    assert html_text.main_text(f'<form id="aspnetForm"><div class="menu">Home</div><main><article>{story}</article></main></form>').startswith("The story")
    assert html_text.main_text(f'<body><form action="/x"><input name="v">{story}<button>Send</button></form></body>').startswith("The story")
    assert html_text.main_text(f"<body><article>{story}</article><form><p>Your name, please</p></form></body>").endswith("words.")
    assert html_text.main_text("<form><label>User</label><p>Log in here</p></form>") == ""


@pytest.mark.parametrize("others", [10, 700])
def test_what_recurs_is_told_by_its_share(spark, others):
    """Cells that a few articles of a large host have in common stay, whatever the host's size; a notice in a paragraph of all pages goes."""
    from quarry.llm import html_text

    notice = "<p>Subscribe to our weekly letter today and save.</p>"
    made = [(i, "http://h/x", f"<article><p>Text number {i} is here.</p>{notice}<table><tr><td>Total</td><td>{i}</td></tr></table><h2>Summary</h2></article>") for i in range(others // 10)]
    made += [(1000 + i, "http://h/y", f"<article><p>Another text, number {i}, is here.</p>{notice}<h2>Summary</h2></article>") for i in range(others)]
    got = {r.page_id: r.text for r in html_text.extract(page_rows(spark, made)).collect()}
    assert got[0] == "Text number 0 is here. Total 0 Summary" and got[1003] == "Another text, number 3, is here. Summary"


def test_templates_are_counted_as_by_hand(spark):
    from quarry.llm import html_text

    rnd = random.Random(5)
    blocks = [f"<div>block {i} of the site</div>" for i in range(6)]
    made = [(i, f"http://h{i % 3}/{i}", "<body>" + "".join(b for k, b in enumerate(blocks) if rnd.random() < k / 6) + f"<p>own words {i // 2}</p></body>") for i in range(60)]
    found = {(r.host, r.hash) for r in html_text.templates(html_text.page_subtrees(page_rows(spark, made))).collect()}
    by, pages = collections.defaultdict(set), collections.defaultdict(set)
    for _, url, page in made:
        host = url[7:9]
        main, trees = html_text.subtrees(page)
        pages[host].add(main)
        for h in trees:
            by[host, h].add(main)
    assert found == {(h, t) for (h, t), m in by.items() if len(m) >= max(html_text.MIN_PAGES, html_text.MIN_SHARE * len(pages[h])) and len(pages[h]) >= html_text.MIN_PAGES}


def test_a_sample_has_one_row_an_id(spark):
    from quarry.llm import labelled

    docs = table(spark, [(i % 4, f"text {i}", "s") for i in range(2000)])
    labels = spark.createDataFrame([(i, int(i > 1), 0) for i in range(4)], LABELS)
    got = labelled.sample(docs, labels, "quality", 4, 9, 3000).collect()
    assert len(got) == 4 and sorted(r.y for r in got) == [0, 0, 1, 1]
    assert labelled.sample(docs, labels, "quality", 4, 9, 1).count() == 2


def test_equal_buckets_count_once(spark):
    """Of buckets with the same members one stays; those that differ in one member stay too."""
    rows = [(k, i, len(m)) for k, m in ((1, [4, 5]), (2, [4, 5]), (3, [4, 5, 6]), (4, [4, 6]), (5, [4, 5, 6])) for i in m]
    got = jaccard_join._distinct_buckets(spark.createDataFrame(rows, "key long, id long, n long")).collect()
    assert sorted((r.key, r.id) for r in got) == [(1, 4), (1, 5), (3, 4), (3, 5), (3, 6), (4, 4), (4, 6)]


def test_equal_buckets_of_bands_count_once(spark):
    """Of near-duplicate buckets with the same members that of the first band stays, whatever its key."""
    from quarry.llm import near_duplicates

    rows = [(k, b, i, len(m)) for k, b, m in ((9, 0, [4, 5]), (2, 1, [4, 5]), (3, 2, [4, 5, 6]), (7, 3, [4, 6])) for i in m]
    got = near_duplicates._distinct_buckets(spark.createDataFrame(rows, "key long, band int, id long, n long")).collect()
    assert sorted((r.key, r.id) for r in got) == [(3, 4), (3, 5), (3, 6), (7, 4), (7, 6), (9, 4), (9, 5)]


def test_no_language_and_no_copied_text_is_toxic(spark):
    """Toxic texts have twice the share of a language, and twenty near copies of one text with words of its own: only the insults are units."""
    from quarry.llm import toxicity

    rnd, insults = random.Random(8), ["scoundrel", "wretchkin", "blockhead", "nitwitted"]
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(5))
    langs = [[word(x) for _ in range(150)] for x in ("abcde", "vwxyz")]
    text = lambda lang, more: " ".join(rnd.sample(w := [*(rnd.choice(langs[lang]) for _ in range(60)), *more], len(w)))
    rows = [(i, text(i % 12 < (4 if i < 400 else 2), rnd.sample(insults, 2) if i < 400 else ()), i < 400) for i in range(1400)]
    own = [word("fghij") for _ in range(60)]
    rows += [(2000 + i, " ".join([*own, insults[i % 4], word("klmno")]), True) for i in range(20)]
    docs, labels = table(spark, [(i, t, "s") for i, t, _ in rows]), spark.createDataFrame([(i, 1, int(y)) for i, _, y in rows], LABELS)
    units = toxicity.train(docs, labels).units
    assert set(insults) <= set(units) <= {u for w in insults for u in toxicity.units_of(w)}


def test_few_cells_are_raked_in_a_few_queries(spark):
    """Both forms of the raking meet the same shares; the one for few cells takes no query a margin and round."""
    from quarry.llm import mixing

    rnd = random.Random(3)
    rows = [(f"s{a}", f"l{b}", f"t{c}", rnd.randint(1, 10**6)) for a in range(6) for b in range(3) for c in range(4) if rnd.random() < 0.8]
    cells = mixing.cut(spark.createDataFrame(rows, "_source string, _lang string, _topic string, tokens long"))
    targets = {m: mixing.cut(mixing.tempered(cells, m)) for m in mixing.MARGINS}
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    shares = {}
    for few in (0, 1000):
        sc.setJobGroup(f"rake{few}", "")
        shares[few] = {r[:3]: r.share for r in mixing.rake(cells, targets, **({} if few else {"few": 0})).collect()}
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert shares[0].keys() == shares[1000].keys() and all(abs(shares[0][k] - v) < 1e-5 for k, v in shares[1000].items())
    assert len(tracker.getJobIdsForGroup("rake1000")) < 45 < len(tracker.getJobIdsForGroup("rake0"))


def test_rounds_of_hubs_leave_out_buckets_that_gain_nothing(spark, monkeypatch):
    """After the first round no small bucket is held against hubs again, and a large one only while its components become fewer; nothing is lost."""
    rnd, seen, by_hubs = random.Random(6), [], jaccard_join._by_hubs

    def spy(placed, *more):
        seen.append({r[0]: r[1] for r in placed.groupBy("key").agg({"n": "max"}).collect()})
        return by_hubs(placed, *more)

    monkeypatch.setattr(jaccard_join, "_by_hubs", spy)
    shared = " ".join(f"s{i}" for i in range(9))
    rows = [(i, shared + " " + " ".join(f"w{rnd.randint(0, 999)}" for _ in range(3)), "x") for i in range(40)]  # 5 of 8 to 10 shingles in common
    rows += [(100 + i, f"other{i // 2} text{i // 2} of six words " + " ".join(f"v{i // 2}-{k}" for k in range(20 + i % 2)), "x") for i in range(20)]
    rows += [(200 + i, "another text of " + " ".join(f"u{k}" for k in range(8)) + f" end{i}", "x") for i in range(12)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(table(spark, rows)).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t, _ in rows for w in [t.split()]}
    near = {i: {j for j in sets if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in sets}
    for _ in range(len(near)):
        near = {i: set().union(*(near[j] for j in s)) for i, s in near.items()} if _ < 6 else near
    assert got == {i: min(s) for i, s in near.items()}
    assert seen[0] and all(n > jaccard_join.PAIRED for later in seen[1:] for n in later.values())
    placed = spark.createDataFrame([(1, i, 30, 9 if i < 20 else i) for i in range(30)] + [(2, i, 30, i) for i in range(30)] + [(3, i, 5, i) for i in range(5)], "key long, id long, n long, comp long")
    large, parts = jaccard_join._paying(placed, None)
    assert {r.key: r.parts for r in parts.collect()} == {1: 11, 2: 30} and large.count() == 60
    again = spark.createDataFrame([(1, 12), (2, 30)], "key long, parts long")
    assert {r.key for r in jaccard_join._paying(placed, again)[0].collect()} == {1}


def test_raking_goes_on_until_the_margins_are_met(spark):
    """Topics that nearly follow the languages need many rounds; margins that contradict each other end with a warning; a budget that fills cell after cell is met."""
    import warnings

    from quarry.llm import mixing

    cells = lambda rows: spark.createDataFrame(rows, "_source string, _lang string, _topic string, tokens long")
    wanted = lambda **t: {m: spark.createDataFrame(list(t[m].items()), "_value string, target double") for m in mixing.MARGINS}
    slow = cells([("s", f"l{a}", f"t{b}", 10**7 if a == b else 30) for a in range(3) for b in range(3)])
    targets = wanted(source={"s": 1.0}, lang={"l0": 0.6, "l1": 0.3, "l2": 0.1}, topic={"t0": 0.1, "t1": 0.3, "t2": 0.6})
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = mixing.rake(slow, targets).toPandas()
    assert abs(got.groupby("_lang").share.sum()["l0"] - 0.6) < 1e-6 and abs(got.groupby("_topic").share.sum()["t2"] - 0.6) < 1e-6
    with pytest.warns(UserWarning, match="contradict"):
        mixing.rake(cells([("s", "l0", "t0", 5), ("s", "l1", "t1", 5)]), wanted(source={"s": 1.0}, lang={"l0": 0.6, "l1": 0.4}, topic={"t0": 0.2, "t1": 0.8})).collect()
    n = 14
    steps = spark.createDataFrame([("s", "l", f"t{i}", 4**i, 3.0**i) for i in range(n)], "_source string, _lang string, _topic string, tokens long, share double")
    total = steps.agg({"share": "sum"}).first()[0]
    kept = mixing.probabilities(steps.selectExpr("_source", "_lang", "_topic", "tokens", f"share / {total} AS share"), 0.9).selectExpr("sum(keep * tokens) / sum(tokens)").first()[0]
    assert abs(kept - 0.9) < 1e-9
