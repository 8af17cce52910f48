import os
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import leaks, looks, mixing, proportions

DOCS = "doc_id long, text string, source string, look string"


def test_forms():
    f = looks.Former().canonical
    same = [("abc", "аbс"), ("Ａ１", "A1"), ("é", "é"), ("a​b﻿", "ab"), ("a b　", "a b "), ("co‐op", "co-op"), ("Å", "Å"), ("µ", "μ"), ("е́", "é"), ("ΑΒ", "AB"), ("x­y", "xy"), ("e‍́", "é")]
    assert all(f(a) == f(b) for a, b in same)
    differ = [("2", "²"), ("e", "é"), ("a", "A"), ("a\tb", "a b"), ("a\nb", "a\r\nb"), ("ハ", "バ"), ("ﬁ", "fi"), ("-", "—")]
    assert all(f(a) != f(b) for a, b in differ)
    assert f("") == "" and f("plain \n text") == "plain \n text"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x7F, exclude_categories=["Cs"]), st.sampled_from("éе̣́‍ Ａµ가가ガガώ"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_segments_equal_the_whole(text):
    """Splicing segments gives what the whole text would give; the form is stable."""
    former = looks.Former()
    whole = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(former.table))
    assert former.canonical(text) == whole
    assert former.canonical(whole) == whole


def test_look_alikes(spark):
    rows = [(1, "pаth", None, ""), (2, "path", None, ""), (3, "path", None, ""), (4, "p​ath", None, ""), (5, None, None, ""), (6, "", None, ""), (7, " ", None, ""), (8, " ", None, ""), (9, "Path", None, ""), (10, "x" * 300_000 + "é", None, ""), (11, "x" * 300_000 + "é", None, ""), (2, "path", None, "")]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, looks.look_alikes(df).collect())) == [(1, 2), (1, 3), (1, 4), (2, 4), (3, 4), (10, 11)]
    form = looks.canonical_texts(df)
    assert form.columns == [*df.columns, "canonical"] and {r.doc_id: r.canonical for r in form.collect()}[1] == "path"
    assert looks.look_alikes(df.filter("false")).count() == 0


def test_token_count(spark):
    texts = ["a b_c, d!!", "é é ²x", "", None, "  \t　\x1c", "αβ-γ 1.5 x", "привет,мир…", "﻿(a)"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in df.select(mixing.token_count(df.text)).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]+", t or "")) for t in texts]


@pytest.fixture(scope="module")
def mix(spark):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 400))), "Big " if k % 5 else "big", "") for k in range(400)] + [(1000 + k, "a b c " * 100, "small", "") for k in range(20)] + [(2000, "lost " * 500, None, ""), (2001, None, "big", ""), (2002, "tok " * 30_000, "long", "")]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([(1, "BIG", 0.7, 1, 0.5), (1, "small", 0.2, 2, 0.5), (1, "none", 0.1, 3, 0.5), (2, "big", 0.5, 2, 0.4), (2, "long", 0.5, 2, 0.4)], "mix_id int, source string, weight double, max_repeats int, budget_share double")
    return docs, targets, mixing.Mix(mixing.document_sizes(docs), targets, block=128)


def test_mix_report(mix):
    docs, _, m = mix
    size = {}
    for r in docs.collect():
        if r.source is not None:
            size[r.source.strip().lower()] = size.get(r.source.strip().lower(), 0) + len(re.findall(r"\w+|[^\w\s]+", r.text or ""))
    total = sum(size.values())
    for r in m.report().collect():
        key = r.source.lower()
        assert r.total == total and r["size"] == size.get(key, 0)
        assert r.failed == (r.weight * (0.5 if r.mix_id == 1 else 0.4) * total > r.max_repeats * size.get(key, 0)) == (r.shortfall > 0)
        assert r.repeats <= r.max_repeats and r.drawn <= r.capacity
        if not r.failed:
            assert abs(r.drawn - r.target) <= 0.02 * r.target + 256


def test_mix_records(mix):
    _, _, m = mix
    rows = m.records().toPandas()
    pieces = rows.groupby(["mix_id", "source", "doc_id", "from_tok", "to_tok"]).size()
    most = {(1, "big"): 1, (1, "small"): 2, (2, "big"): 2, (2, "long"): 2}
    assert all(n <= most[k[0], k[1]] for k, n in pieces.items())
    blocks = m.blocks.toPandas()
    whole = blocks.assign(n=blocks.to_tok - blocks.from_tok).groupby(["source", "block"]).n.sum()
    assert (whole <= 128).all()
    covered = blocks.assign(n=blocks.to_tok - blocks.from_tok).groupby("doc_id").n.sum().to_dict()
    assert covered == {r.doc_id: r.n_tok for r in m.sizes.collect() if r.n_tok}
    again = m.records().toPandas()
    key = list(rows.columns)
    assert rows.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_sizes_by_vocabulary(spark):
    from chronoloom.llm.queries import VOCABULARY

    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary")
    df = spark.createDataFrame([(1, "hello world", "A ", ""), (2, None, "b", ""), (3, "", "b", ""), (4, "x", None, ""), (5, "<|endoftext|>", "b", "")], DOCS)
    got = {r.doc_id: (r.source, r.n_tok) for r in mixing.sizes_by_vocabulary(df, VOCABULARY).collect()}
    assert got[1] == ("a", 2) and got[2] == ("b", 0) and got[3] == ("b", 0) and 4 not in got and got[5][1] > 1


def test_permutations():
    for n in (1, 2, 3, 10, 257, 1000):
        i = np.arange(n)
        for seed in (0, -5, 2**62):
            p = mixing.permuted(i, np.full(n, n), np.full(n, seed))
            assert sorted(p) == list(range(n))
    assert list(mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, 1))) != list(mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, 2)))


def test_empty_mix(mix):
    docs, targets, _ = mix
    m = mixing.Mix(mixing.document_sizes(docs.filter("false")), targets)
    assert m.report().filter("failed").count() == 0 and m.records().count() == 0


SAMPLES = "sample_id long, dataset string, label int, plan_id int"


def test_proportions(spark):
    rows = [(k, "a", 0 if k % 10 else 1, 77) for k in range(2000)] + [(5000 + k, "a", 2, 77) for k in range(3)] + [(0, "a", 1, 77), (9000, "a", None, 0), (9001, None, 1, 0), (None, "a", 1, 0), (7000, "b", 0, 0)]
    samples = spark.createDataFrame(rows, SAMPLES)
    targets = spark.createDataFrame([(1, "a", 0, "x", 0.5, 5, 0.3), (1, "a", 1, "y", 0.25, 5, 0.3), (1, "a", 2, "z", 0.2, 5, 0.3), (1, "a", 3, "none", 0.05, 2, 0.3), (2, "b", 0, "x", 1.0, 3, 0.5), (3, "zz", 0, "x", 1.0, 1, 0.5)], "plan_id int, dataset string, label int, label_name string, target_share double, min_rows int, sample_frac double")
    rep = {(r.plan_id, r.label): r for r in proportions.draw_report(samples, targets).collect()}
    usable = 2003
    have = {0: 1800, 1: 200, 2: 3, 3: 0}
    for label, share, least in ((0, 0.5, 5), (1, 0.25, 5), (2, 0.2, 5), (3, 0.05, 2)):
        r = rep[1, label]
        want = share * 0.3 * usable
        assert r.usable == usable and r.available == have[label] and r.failed == (have[label] < want or have[label] < least)
        assert r.drawn == r.quota == min(have[label], max(int(np.ceil(want)), least))
    assert rep[2, 0].failed and rep[2, 0].drawn == 1 and rep[3, 0].failed and rep[3, 0].drawn == 0
    drawn = proportions.draw(samples, targets)
    assert drawn.count() == drawn.select("plan_id", "sample_id").distinct().count()
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, proportions.draw(samples.repartition(7), targets).collect()))
    assert proportions.draw(samples.filter("false"), targets).count() == 0


WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "se") for b in ("n", "t", "x", "d", "p", "r", "v", "g")]


def brute_leaks(docs, items):
    former = looks.Former()
    grams = lambda t: {tuple(w[i : i + 13]) for w in [leaks.words_of(t or "", former)] for i in range(len(w) - 12)}
    g = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs for i in g if g[i] & grams(t)}


def test_leaks(spark):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    items = [(k, f"Task {k}:\n" + text(40)) for k in range(12)] + [(50, None), (51, ""), (52, "short one"), (53, "1 " * 30)]
    docs = [(k, text(120)) for k in range(40)]
    for k, n in enumerate((12, 13, 14, 20, 30)):
        for start in (0, 3, 5):
            body = items[k][1].split("\n")[1].split()[start : start + n]
            docs.append((1000 + k * 10 + start, text(int(rng.integers(0, 17))) + " zzz " + "_".join(body).upper() + ". " + text(9)))
    docs += [(2000, None), (2001, ""), (2002, items[3][1]), (2002, items[3][1]), (2003, " ".join(items[4][1].split()).replace("a", "а")), (2004, text(30_000) + " " + items[5][1])]
    df = spark.createDataFrame([(*d, None, "w") for d in docs], DOCS)
    it = spark.createDataFrame([(*i, "doc") for i in items], "item_id long, text string, suite string")
    out = leaks.leaks(df, it)
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    assert got == brute_leaks(docs, items) and len(got) > 10
    runs = {(r.doc_id, r.item_id): r.longest_run for r in out.collect()}
    assert runs[2002, 3] >= 40 and all(v >= 13 for v in runs.values())
    assert leaks.leaks(df.filter("false"), it).count() == 0 and leaks.leaks(df, it.filter("false")).count() == 0


def test_paraphrases(spark):
    rng = np.random.default_rng(10)
    words = rng.choice(WORDS, 60).tolist()
    changed = [w if k % 9 != 8 else "other" for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(changed), None, ""), (2, " ".join(rng.choice(WORDS, 60)), None, "")], DOCS)
    items = spark.createDataFrame([(7, "head\n" + " ".join(words))], "item_id long, text string")
    assert leaks.leaks(docs, items).count() == 0
    out = leaks.leaks(docs, items, paraphrases=True).collect()
    assert [(r.doc_id, r.item_id) for r in out] == [(1, 7)] and out[0].lcs_share > 0.8 and out[0].longest_run < 13


def test_near_windows_of_all_centres():
    from types import SimpleNamespace

    rng = np.random.default_rng(5)
    windows, terms = rng.integers(0, 60, (900, leaks.PASSAGE)), rng.standard_normal((60, 4)).astype(np.float32)
    search = leaks.Search(SimpleNamespace(windows=windows), terms, centres=20)
    m = windows[:200].copy()
    m[:, 2] = -1
    got = set(zip(*(z.tolist() for z in search.candidates(m, 0.9)), strict=True))
    cosine = search.place(m) @ search.w.T
    assert set(zip(*np.nonzero(cosine >= 0.9001), strict=True)) <= got <= set(zip(*np.nonzero(cosine >= 0.8999), strict=True))
    same = set(zip(*(z.tolist() for z in search.candidates(windows[:200])), strict=True))
    assert {(k, k) for k in range(200)} <= same


def test_common_subsequence():
    rng = np.random.default_rng(11)
    for _ in range(30):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 15)
        t = np.zeros((13, 16), int)
        for i in range(12):
            for j in range(15):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert leaks.common_subsequence(a, b) == t[-1, -1]
