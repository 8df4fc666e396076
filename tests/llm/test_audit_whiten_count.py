import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import SF, docs, empty  # noqa: F401
from trendspark.llm import divergence, queries, token_counts, whitening

settings.register_profile("steady", deadline=None)
settings.load_profile("steady")


# ---------------------------------------------------------------- source divergence

def brute_divergences(rows, least_docs=10, top=10):
    """(text, lang, source) rows to (lang, source, part, item, value, rank), in plain Python."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang in held:
        kept = [t for t, n in held[lang].items() if n >= least_docs]
        groups = {s: c for (of, s), c in counts.items() if of == lang}

        def p(count, total):
            return 1 + 10 ** 9 * (count + 2) // (total + 2 * len(kept))

        totals = {s: sum(c[t] for t in kept) for s, c in groups.items()}
        everything = {t: sum(c[t] for c in groups.values()) for t in kept}
        for s, own in groups.items():
            pairs, terms = [], []
            for other, c in groups.items():
                if other != s:
                    f = [((a := p(own[t], totals[s])) - (b := p(c[t], totals[other]))) ** 2 // (a + b) for t in kept]
                    pairs.append((sum(f), other))
            for t in kept:
                a, b = p(own[t], totals[s]), p(everything[t], sum(totals.values()))
                if own[t] and a > b:
                    terms.append(((a - b) ** 2 // (a + b), t))
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [divergence.CELLS, 150])
def test_divergences_equal_brute_force(spark, cells):
    texts = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "en", "s"), ("", None, None), ("Été \x00 ÀB k", "en", None), ("word", "xx", "only"),
                                 ("12 34", "xx", "none"), ("a " * 50_000, "en", "s")] + [("K K z", "zz", s) for s in "ab" for _ in range(6)],
                                "text string, lang string, source string")
    rows = texts.select("text", "lang", "source").unionByName(odd)
    found = divergence.divergences(rows, cells=cells)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute_divergences([tuple(r) for r in rows.collect()])


def test_divergences_of_odd_tables(docs, empty):
    assert divergence.divergences(empty).count() == 0
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert sorted(map(tuple, divergence.divergences(docs, least_docs=2).collect())) == brute_divergences(rows, 2)
    assert {r["value"] for r in divergence.divergences(docs, least_docs=100).collect()} == {0}


def test_scaled_is_exact_for_large_counts():
    count, total = [0, 7, 10 ** 12, 8 * 10 ** 15], 9 * 10 ** 15
    assert divergence.scaled(np.array(count), np.int64(total)).tolist() == [1 + 10 ** 9 * (c + 2) // total for c in count]


def test_term_counts_in_pieces_and_flushes(monkeypatch, spark):
    rows = [("a b a", "en", "s"), ("", "en", "t"), ("b c", "en", "s"), ("x" * 100, "de", "s")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(r[1], r[2], r[0]) for r in rows])], names=["lang", "source", "text"])
    whole = divergence.added([divergence.term_counts(batch)])
    parts = [divergence.term_counts(p) for p in divergence.pieces(batch, 4)]
    assert len(parts) > 1 and sorted(divergence.added(parts).to_pylist(), key=str) == sorted(whole.to_pylist(), key=str)
    assert {(r["lang"], r["source"]): r["docs"] for r in whole.to_pylist() if r["term"] is None} == {
        ("en", "s"): 2, ("en", "t"): 1, ("de", "s"): 1}


# ---------------------------------------------------------------- whitening

@given(st.integers(1, 12), st.integers(0, 4), st.integers(0, 2 ** 31))
def test_rank_one_updates_equal_a_dense_solver(size, kind, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, size))
    if kind == 1:
        x *= 10.0 ** rng.uniform(-8, 4, size=size)
    elif kind == 2:
        x = np.round(x)  # equal poles
    elif kind == 3:
        x = np.repeat(x[:3], 10, axis=0)  # deficient rank
    elif kind == 4:
        x[:, : size // 2] = 0
    spectrum, scatter = whitening.Spectrum(size), np.cov(x.T, bias=True).reshape(size, size) * len(x)
    spectrum.fold(x, False)
    scale = max(np.abs(scatter).max(), 1e-300)
    assert np.abs(spectrum.basis.T @ spectrum.basis - np.eye(size)).max() < 1e-12
    assert np.abs(spectrum.basis * spectrum.values @ spectrum.basis.T - scatter).max() < 1e-12 * scale * size
    both, other, block = whitening.Spectrum(size), whitening.Spectrum(size), whitening.Spectrum(size)
    both.fold(x[:20], False)
    other.fold(x[20:], True)
    block.fold(x, True)
    again = whitening.Spectrum(size, whitening.merged_spectra(size)([both.packed(), other.packed()]))
    for s in (again, block):
        assert s.n == 30 and np.abs(s.basis * s.values @ s.basis.T - scatter).max() < 1e-12 * scale * size


def brute_whitening(vectors, most=4):
    """Fit list, sums, eigenvalues, eigenvectors and trace by numpy."""
    fit = np.array(sorted(set(map(tuple, np.floor(256 * vectors).astype(int).tolist()))))
    sums = fit.sum(axis=0)
    centred = fit - sums / len(fit)
    cov = centred.T @ centred / len(fit)
    values, basis = np.linalg.eigh(cov)
    return len(fit), sums, values[::-1][:most], basis[:, ::-1][:, :most], np.trace(cov)


def test_whitening_query_equals_numpy(spark):
    given_rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    vectors = np.array([r["embedding"] for r in given_rows], dtype=float)
    n, sums, values, basis, trace = brute_whitening(vectors)
    out = queries.QUERIES["op12_incremental_whitening"](spark, SF).collect()
    assert len(out) == 4 * len(given_rows)
    x = np.floor(256 * vectors).astype(int)
    expected = (x - sums / n) @ basis / np.sqrt(values)
    place = {r["vec_id"]: i for i, r in enumerate(given_rows)}
    found = np.zeros_like(expected)
    for r in out:
        i, k = place[r["vec_id"]], r["component"] - 1
        found[i, k] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
        assert math.isclose(r["explained"], values[k] / trace, rel_tol=1e-12) and r["identity_error"] < 1e-10
    sign = np.sign((found * expected).sum(axis=0))
    assert np.abs(found * sign - expected).max() < 1e-8


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = np.round(rng.normal(size=(50, 3)) * 512) / 256
    rows = [(i, v.tolist()) for i, v in enumerate(good)] + [(100 + i, good[i % 2].tolist()) for i in range(40)]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [float("inf"), 1.0, 1.0]),
           (205, [1e300, 1.0, 1.0]), (206, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x", 0) for i, v in rows + bad], "vec_id long, embedding array<double>, x string, n int")
    for compress in (False, True):
        out = whitening.whiten(whitening.quantised(table), compress=compress).collect()
        assert sorted(r["row"]["vec_id"] for r in out) == sorted(i for i, _ in rows for _ in range(3))
        n, sums, values, basis, trace = brute_whitening(good, 3)
        assert {r["n"] for r in out} == {n} and max(r["identity_error"] for r in out) < 1e-10
        share = {r["component"]: r["explained"] for r in out}
        assert np.allclose([share[k] for k in (1, 2, 3)], values / trace, rtol=1e-12)
        by_row = {(r["row"]["vec_id"], r["component"]): r["whitened"] for r in out}
        assert all(by_row[100, k] == by_row[0, k] for k in (1, 2, 3))
    flat = table.where("vec_id = 0").unionByName(table.where("vec_id = 0"))
    for none in (table.where("false"), table.where("vec_id >= 200 and vec_id < 206"), flat):
        assert whitening.whiten(whitening.quantised(none)).count() == 0


def test_deviation_beyond_a_long_is_exact():
    centre = whitening.Centre(3 * 10 ** 9, [5 * 10 ** 9, -7])
    x = np.array([[12, -3], [10 ** 7, 0]])
    assert [int(v) for v in centre.deviation(x).to_pylist()] == [
        sum((3 * 10 ** 9 * int(a) - s) ** 2 for a, s in zip(r, centre.sums)) for r in x]


def test_many_spectra_are_combined_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    x = np.random.default_rng(1).integers(-50, 50, size=(400, 4))
    fit = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").distinct().repartition(20)
    w = whitening.fit_whitening(fit, 4)
    _, _, values, _, _ = brute_whitening(x / 256.0)
    assert np.allclose(w.values, values, rtol=1e-12)


# ---------------------------------------------------------------- token counts

def library(found=[]):
    from tokenizers import Tokenizer
    if not found:
        found.append(Tokenizer.from_file(token_counts.tokenizer_path()))
    return found[0]


def expected_tokens(text):
    return len(library().encode(text, add_special_tokens=False).ids)


@given(st.text(alphabet="abE's ’tLl1²٣éÉß中文İΣσς́̇ͅẞK\u0085​\x1c\x0b\x00😀ﬁ<|endoftext|>͸\U0001fae9Ᲊ", max_size=40))
def test_counts_equal_the_tokenizer_on_any_text(text):
    assert token_counts.counter(token_counts.tokenizer_path()).count(text) == expected_tokens(text)


def test_counts_equal_the_tokenizer_on_all_characters():
    count = token_counts.counter(token_counts.tokenizer_path()).count
    for low in range(0, 0x110000, 512):
        text = " ".join(f"a{c}b{c}1!{c}" for c in map(chr, range(low, low + 512)) if not "\ud800" <= c < "")
        assert count(text) == expected_tokens(text), hex(low)


def test_counts_of_long_words_and_special_strings():
    count = token_counts.counter(token_counts.tokenizer_path()).count
    long = "".join(chr(97 + (i * i // 7) % 26) for i in range(100_000))
    for text in (long, "the " * 50_000, "<|endoftext|>" * 9, "x<|startoftext|><|ENDOFTEXT|>", "<|<|endoftext|>|>"):
        assert count(text) == expected_tokens(text)


def test_merges_pop_the_lowest_rank_and_skip_stale_pairs():
    c = token_counts.counter(token_counts.tokenizer_path())
    plain = dict(c.ranks)

    def slow(word):
        symbols = [c.letters[b] for b in word.encode()]
        symbols[-1] += c.end
        while ranked := [(plain[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in plain]:
            _, i = min(ranked)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        return len(symbols)

    for word in ("aaaaaaaaaaa", "banananana", "thethethe", "supercalifragilistic", "ééééé", "日本語日本語"):
        assert c.merged([c.letters[b] for b in word.encode()]) == slow(word)


def test_token_count_query_and_odd_rows(spark, docs, empty):
    rows = token_counts.counted(docs).collect()
    assert len(rows) == docs.count() and set(rows[0].asDict()) == {"row", "n_bytes", "n_tokens"}
    for r in rows:
        text = r["row"]["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), expected_tokens(text))
    assert token_counts.counted(empty).count() == 0
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op13_heap_bpe_counts"](spark, SF).collect():
        n = expected_tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 2048)
