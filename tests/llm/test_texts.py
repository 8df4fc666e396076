import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_fixtures import docs, empty  # noqa: F401
from trendspark.llm import chat, licenses, packing, quality, toxicity, url_filter

settings.register_profile("steady", deadline=None)
settings.load_profile("steady")


# ---------------------------------------------------------------- packing

def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.tokenizer_paths()[0])


def test_encoder_equals_the_tokenizer():
    enc, tok = packing.Encoder(packing.tokenizer_paths()), tokenizer()
    texts = ["", " ", "a", "a  b", "x <|endoftext|> y", "a\nb", "a\n\nb", " a", "a ", "don't we'll", "a\tb", "q\x1cz w",
             "a\0b c", "é日本 語\nx's 'S", "a b\x85c", "tab\x0bvt", "1234 56\n7 8.9", "😀 😀😀\n\n  x"]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@given(st.text(alphabet="ab'sé1 \n\t<|\xa0", max_size=40))
def test_encoder_equals_the_tokenizer_on_any_text(text):
    enc = packing.encoder(packing.tokenizer_paths())
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == tokenizer_once().encode(text, add_special_tokens=False).ids


def tokenizer_once(found=[]):
    if not found:
        found.append(tokenizer())
    return found[0]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=40))
def test_patterns_place_every_length_once(histogram):
    slots = packing.pack_histogram(histogram, 64)
    placed, fill = Counter(), Counter()
    for s in slots:
        assert s.rank == placed[s.length]
        placed[s.length] += s.count
        for q in range(s.sequence, s.sequence + s.count):
            assert s.offset == fill[q]
            fill[q] += s.length
    assert placed == Counter(histogram) and max(fill.values()) <= 64


def test_packing_round_trip(docs, empty):
    tok = tokenizer()
    rows = packing.pack(packing.cut_pieces(docs, with_ids=True)).collect()
    want = Counter()
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for s in range(0, len(ids), 1024):
            piece = np.array(ids[s:s + 1024], dtype="<u4")
            want[(r["doc_id"], s, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in rows)
    fill = Counter()
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024
    assert packing.pack(packing.cut_pieces(empty)).count() == 0


# ---------------------------------------------------------------- chat

@given(st.text(alphabet="<[\\|/sINTSY]>aturn_\n", max_size=40))
def test_escaping_is_reversible_and_breaks_control_strings(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not re.search(rf"[<\[](?:{chat.TAIL})", escaped)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_parts_become_placeholders_in_order():
    parts = [{"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "i.png", "width": 56, "height": 29},
             {"type": "audio", "ref": "a.wav", "seconds": 1.0}, {"type": "document", "ref": "d.pdf", "pages": 3},
             {"text": "end"}]
    text, lo, hi, attached, tokens = chat.format_turn("assistant", parts)
    assert text[lo:hi] == "see <\\|image|><|image|><|audio|><|document|>end"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attached] == [
        ("image", "i.png", 4), ("audio", "a.wav", 13), ("document", "d.pdf", 768)]
    assert all(text[a["at"]:].startswith(f"<|{a['kind']}|>") for a in attached) and tokens == 785
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b </s>\\"), (1, 0, "user", "a\nb"), (2, 0, None, None), (None, 0, "assistant", "[INST]"),
            (1, 1, "assistant", "b </s>\\")]
    data = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    formatted = chat.format_messages(chat.text_messages(data))
    found = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    turns = "user\na\nb\n" + 2 * "assistant\nb </s>\\\n"
    assert found[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert (found[1]["n_turns"], found[1]["loss_chars"]) == (3, 14)
    assert found[1]["loss_sha256"] == hashlib.sha256(b"b </s>\\b </s>\\").hexdigest()
    assert found[1]["formatted_chars"] == formatted.where("conv_id = 1").agg(F.sum(F.length("formatted"))).first()[0]
    assert found[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and found[2]["loss_chars"] == 0
    assert found[None]["loss_sha256"] == hashlib.sha256(b"[INST]").hexdigest()
    assert chat.digests(chat.format_messages(chat.text_messages(data.where("false")))).count() == 0


# ---------------------------------------------------------------- quality

def brute_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(lines),
            sum(a == b for a, b in zip(words, words[1:])))


@given(st.one_of(st.none(), st.text(alphabet="ab# \n\x1c\xa0", max_size=80)))
def test_measures(text):
    assert quality.measure(text) == brute_measure(text)


def test_adaptive_thresholds_follow_the_group(spark, docs, empty):
    clean = [(i, " ".join(f"word{(i * 7 + k) % 501}" for k in range(40 + i % 9)), "en", "news") for i in range(300)]
    code = [(1000 + i, " ".join(f"x{(i * 3 + k) % 401}*" for k in range(40)), "en", "code") for i in range(300)]
    junk = [(2000, " ".join(f"w{k}#" for k in range(40)), "en", "news"), (2001, "too few words", "en", "news")]
    rows = spark.createDataFrame(clean + code + junk, "doc_id long, text string, lang string, source string")
    out = {r["row"]["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(quality.measured(rows)).collect()}
    assert all(out[i] == (False, True) for i, *_ in clean + code)  # symbols are usual in code
    assert out[2000] == (False, False) and out[2001] == (True, False)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and quality.keep_good(empty).count() == 0
    assert len(quality.judge(quality.measured(docs)).collect()) == docs.count()


def test_rates_that_a_source_never_has(spark):
    clean = [(i, " ".join(f"word{(i * 7 + k) % 501}" for k in range(60)), "en", "news") for i in range(300)]
    twice = " ".join([*(f"a{k}" for k in range(19)), *(f"b{k}" for k in range(162)), *(f"a{k}" for k in range(19))])
    often = [(500 + i, twice, "en", "forum") for i in range(300)]
    rows = spark.createDataFrame(clean + [(1000, twice, "en", "news")] + often, "doc_id long, text string, lang string, source string")
    out = {r["row"]["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(quality.measured(rows)).collect()}
    assert out[1000] == (False, False)  # 19 % repeated, in a source without repeats
    assert all(out[i] == (False, True) for i in [*range(300), *range(500, 800)])


def plain_kept(rows, error=None):
    """Verdicts by sorting each group's values; with ``error`` a quantile is the middle of its bucket."""
    def value(c, m):
        return {"symbols": c["n_symbols"] / max(c["n_words"], 1), "dup_lines": c["n_dup_lines"] / max(c["n_lines"], 1),
                "repeats": c["n_repeat_words"] / max(c["n_words"], 1), "stutter": c["n_stutter"] / max(c["n_words"], 1),
                "word_length": c["word_chars"] / max(c["n_words"], 1)}[m]

    def rank(values, p):
        v = sorted(values)[max(math.ceil(p * len(values)), 1) - 1]
        if not v or not error:
            return v
        growth = (1 + error) / (1 - error)
        return growth ** math.ceil(math.log(v) / math.log(growth)) * (1 - error)

    passed = [r for r in rows if r["n_words"] >= 10 and 5 * r["n_repeat_words"] <= r["n_words"]]
    out = []
    for r in rows:
        group = [x for x in passed if (x["lang"], x["source"]) == (r["lang"], r["source"])]
        if len(group) < 100:
            group = [x for x in passed if x["lang"] == r["lang"]]
        if len(group) < 100:
            group = passed
        kept = r["n_words"] >= 10 and 5 * r["n_repeat_words"] <= r["n_words"]
        for m, slack, noise, low, tail in (("symbols", 0.10, 0, False, (0.05, 0)), ("dup_lines", 0.45, 1, False, (0.15, 1)),
                                           ("repeats", 0.20, 0, False, (0.05, 1)), ("stutter", 0.15, 0.5, False, None),
                                           ("word_length", 1.0, 8, True, None)):
            values, v, words = [value(x, m) for x in group], value(r, m), max(r["n_words"], 1)
            q1, q3 = rank(values, 0.25), rank(values, 0.75)
            kept &= v - noise / words ** 0.5 <= q3 + 3 * (q3 - q1) + slack
            kept &= not low or v + noise / words ** 0.5 >= q1 - 3 * (q3 - q1) - slack
            kept &= not tail or v - tail[1] / words ** 0.5 <= rank(values, 0.99) + tail[0]
        out.append(kept)
    return out


def test_verdicts_equal_a_plain_version(spark, docs):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    many = documents.select("doc_id", "text", "lang", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("source"))
    for table in (many, docs):
        rows = quality.judge(quality.measured(table)).collect()
        assert [r["kept"] for r in rows] == plain_kept(rows, quality.ERROR)
        assert [r["kept"] for r in rows] == plain_kept(rows)  # no text here lies within the error of a fence


def test_sketches_merge_and_repeat(spark):
    """Of 1,000,000 rows in any order and partitioning the same fences, within the error of exact ones."""
    def rows(order, parts):
        base = spark.range(1_000_000).repartition(parts, F.xxhash64("id", F.lit(order)))
        return base.select(
            F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, "hot").alias("source"), (20 + F.col("id") % 977).alias("n_words"),
            (90 + 5 * (F.col("id") % 977) + F.col("id") % 61).alias("word_chars"), (F.col("id") % 13).alias("n_symbols"),
            F.lit(0).alias("n_dup_lines"), (F.col("id") % 4).alias("n_repeat_words"), F.lit(3).alias("n_lines"), (F.col("id") % 7).alias("n_stutter"))

    found = [sorted(map(str, quality.fences_of(rows(k, parts)).collect())) for k, parts in ((1, 3), (2, 16))]
    assert found[0] == found[1]
    table = quality.sketches(rows(3, 8).where("source is null")).unionByName(quality.sketches(rows(3, 8).where("source is not null")))
    out = {r["measure"]: r for r in quality.quantiles(quality.merged(table, "lang"), ["lang"], {"q": 0.75}).collect()}
    for m, (value, *_) in quality.MEASURES.items():
        exact = rows(1, 8).selectExpr(f"percentile_disc(0.75) within group (order by {value}) as q").first()["q"]
        assert out[m]["total"] == 1_000_000 and abs(out[m]["q"] - exact) <= quality.ERROR * exact * 1.000001


# ---------------------------------------------------------------- toxicity

def toxic_corpus():
    texts, labels = [], []
    for i in range(240):
        words = [f"w{(i * 31 + k * 17) % 400}" for k in range(20 + i % 60)]
        if i % 4 == 0:
            words[3], words[9] = "idiot", "bozo" + "abcdef"[i % 6]
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_gap_powers_equal_plain_forward_backward():
    model = toxicity.Model({"bad": 3.0, "worse": -1.0}, -2.0, [[0.3, -0.5], [-0.2, 0.8]])
    words = ("a b bad c " + "d " * 150 + "bad worse e f g bad").split()
    at, p = model.tag(" ".join(words))
    move = np.exp(model.change)
    gain = [np.array([1, np.exp(model.bias + model.weights.get(w, 0))]) for w in words]
    forward, state = [], np.array([1.0, 0.0])
    for g in gain:
        state = (state @ move) * g
        state /= state.sum()
        forward.append(state)
    back, want = np.ones(2), [0.0] * len(words)
    for i in range(len(words) - 1, -1, -1):
        both = forward[i] * back
        want[i] = both[1] / both.sum()
        back = move @ (gain[i] * back)
        back /= back.sum()
    assert [words[i] for i in at] == ["bad", "bad", "worse", "bad"]
    assert p == pytest.approx([want[i] for i in at], rel=1e-9)


def test_crf_learns_spans_and_scores(spark):
    texts, labels = toxic_corpus()
    model = toxicity.train(texts, labels)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(1000, None, 1), (1001, "", 1), (1002, "clean words only", 1),
                                                       (1003, "You IDIOT, bozoz there", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    assert all(out[i]["predicted"] == y for i, y in enumerate(labels))
    assert out[1000]["score"] == out[1001]["score"] == out[1002]["score"] < 0.5
    assert [rows[-1][1][s["start"]:s["end"]] for s in out[1003]["spans"]] == ["IDIOT, bozoz"]
    assert toxicity.score_documents(docs.where("false"), model).count() == 0


def test_sample_is_bounded_and_never_held_out(spark):
    labels = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
    docs = labels.select("doc_id", F.concat(F.lit("t"), F.col("doc_id")).alias("text"))
    texts, y = toxicity.labelled_sample(docs, labels, most_toxic=10, most_clean=20)
    assert (len(texts), sum(y)) == (30, 10)
    assert all(zlib.crc32(t[1:].encode()) % 5 for t in texts)


def test_held_out_accuracy():
    import duckdb

    rows = duckdb.sql("""select d.doc_id, d.text, l.toxic from '/root/testdata/sf0.1/documents.parquet' d
                         join '/root/testdata/sf0.1/labels.parquet' l using (doc_id) order by d.doc_id""").fetchall()
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    learn = [r for r in learn if r[2]] + [r for r in learn if not r[2]][:1200]
    model = toxicity.train([r[1] for r in learn], [r[2] for r in learn], rounds=40)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    right = sum((model.score(model.tag(t)[1]) >= 0.5) == y for _, t, y in held)
    assert right / len(held) > 0.97


# ---------------------------------------------------------------- licenses

def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        want = phrase.split(" ")
        own = [i for i in range(len(words)) if words[i:i + len(want)] == want]
        places += own
        labels |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark, docs, empty):
    mit = dict(enumerate(t for _, t in licenses.TEMPLATES))[0]
    inserted = mit.replace("copies of this software", "copies").replace("to any person", "to any real person")
    texts = [None, "", "é É MIT-License; the mit license. CC\nBY", "x " * 50 + mit + " y" * 50, "lead " + inserted + " tail",
             "GNU General Public Licenses", "gnu general\tpublic license gnu general public license", "mit",
             "All rights reserved. No part of this publication may be reproduced distributed or transmitted in any form or by any means"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    data = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")
    found = licenses.scan(data).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: r for r in found}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(t), t
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[3]["labels"] == "mit" and got[4]["labels"] == "mit" and got[8]["labels"] == "proprietary"
    assert got[7]["labels"] == "" and got[7]["score"] == 0
    span = licenses.license_spans(data).where("doc_id = 3").first()
    assert span["first_word"] == 50 and span["covered"] == 1.0
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty).count() == 0


def test_short_notices_alone(spark):
    texts = {"All rights reserved.": "proprietary", "all RIGHTS\nreserved": "proprietary",
             "All rights reserved. " * 9: "proprietary", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
             "Licensed under CC BY-SA 3.0.": "cc-by,cc-by-sa", "Licensed under CC BY-ND.": "cc-by,cc-by-nd",
             "Licensed under the Mozilla Public License.": "mpl", "Under the BSD 3-Clause License": "bsd",
             "All rights": "", "all the rights reserved": "", "CC NC": ""}
    data = spark.createDataFrame([(i, f"on the {t} she said") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(data).collect()}
    for i, (t, want) in enumerate(texts.items()):
        named = licenses.MENTIONED if t.startswith("Under the BSD") else float(want != "")
        assert (got[i]["labels"], got[i]["score"]) == (want, named), t


def test_every_notice_alone_and_in_a_text(spark):
    filler = " ".join(f"filler{i}" for i in range(40))
    every = [(label, body, 1.0) for label, body in licenses.TEMPLATES] + [(label, body, licenses.MENTIONED) for label, body in licenses.MENTIONS]
    rows = [(i, side + body + side) for i, (_, body, _) in enumerate(every) for side in ("", f" {filler} ")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        label, body, score = every[r["doc_id"]]
        base = set(brute_base(body)[4].split(",")) - {""}
        assert set(r["labels"].split(",")) == base | {label}, (body, r["labels"])
        assert r["score"] == score or base and r["score"] >= licenses.MENTIONED, body


def test_a_mention_scores_less_than_a_grant(spark):
    texts = ["we talked about the GNU Lesser General Public License and its critics",
             "this file is licensed under the GNU Lesser General Public License", "a talk on the mit license", "SPDX-License-Identifier: MIT",
             "SPDX-License-Identifier: GPL-3.0-only", "Licensed under CC0 1.0 Universal.", "SPDX-License-Identifier: Foo", "the EUPL"]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in
           licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [("lgpl", 0.5), ("lgpl", 1.0), ("mit", 0.5), ("mit", 1.0), ("gpl", 1.0), ("cc0", 1.0),
                                                   ("", 0.0), ("", 0.0)]


def test_labels_of_documents_agree_with_plain_word_search(spark):
    """A notice that stands in a text word for word gives its label, or one that holds all its words; a label
    comes from a base phrase or from a notice of which most k-grams are in the text."""
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    every = [(label, plain(body)) for label, body in licenses.TEMPLATES + licenses.MENTIONS]
    for r in licenses.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        words, labels = plain(documents[r["doc_id"]]), set(r["labels"].split(",")) - {""}
        joined, grams = f" {' '.join(words)} ", set(zip(words, words[1:], words[2:]))
        there = [(label, t) for label, t in every if f" {' '.join(t)} " in joined]
        for label, t in there:
            assert label in labels or any(f" {' '.join(t)} " in f" {' '.join(o)} " for other, o in there if other in labels and other != label)
        for label in labels - (set(r["base_labels"].split(",")) - {""}):
            shares = [sum(g in grams for g in zip(t, t[1:], t[2:])) / (len(t) - 2) for other, t in every if other == label]
            assert max(shares) >= 0.6


def test_licenses_are_told_apart(spark):
    cc = "This work is licensed under a Creative Commons {} 4.0 International License."
    gnu = "This work is licensed under the GNU {}General Public License, version 3."
    body = dict(enumerate(t for _, t in licenses.TEMPLATES))
    bsd = next(t for _, t in licenses.TEMPLATES if t.startswith("Redistribution"))
    texts = {cc.format("Attribution"): "cc-by", cc.format("Attribution-ShareAlike"): "cc-by-sa",
             cc.format("Attribution-NonCommercial"): "cc-by-nc", cc.format("Attribution-NoDerivatives"): "cc-by-nd",
             cc.format("Attribution-NonCommercial-ShareAlike"): "cc-by-nc-sa",
             cc.format("Attribution-NonCommercial-NoDerivatives"): "cc-by-nc-nd",
             cc.format("Attribution") + " x " + cc.format("Attribution-ShareAlike"): "cc-by,cc-by-sa",
             cc.format("Attribution-NonCommercial-NoDerivatives").replace("a Creative", "one Creative"): "cc-by-nc-nd",
             gnu.format(""): "gpl", gnu.format("Lesser "): "lgpl", gnu.format("Affero "): "agpl",
             "Licensed under CC BY-NC-SA 4.0.": "cc-by,cc-by-nc-sa", "Licensed under CC BY-NC-ND 4.0.": "cc-by,cc-by-nc-nd",
             "This project is licensed under the terms of the ISC license.": "isc",
             "This project is licensed under the terms of the Foo license.": "",
             "Released under the MIT License. " * 5: "mit", "All rights reserved. " + bsd: "bsd", body[0]: "mit"}
    data = spark.createDataFrame([(i, f"words before {t} and after") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(data.union(data.where("doc_id = 1"))).collect()}
    for i, (t, want) in enumerate(texts.items()):
        assert got[i] == want, t


# ---------------------------------------------------------------- urls

def test_urls(spark):
    urls = [None, "", "no-mark", "http://A.EXAMPLE.net/en/1?q", "http://x.net", "http://x.net/", "http://notnet/",
            "https://example.com/de/1", "https://example.com/De/1", "http://a.org/fr/x#y", "ftp://h?x/y", "http://net/a",
            "http://www.cheap-pills.test/x", "http://q.test/casino", "http://q.test/casinos", "http://q.test/en/archive?casino/",
            "http://q.test/casino/en/archive", "http://q.test/a?utm_source=spam&x=1"]
    data = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")],
                                 "page_id long, url string, host string")
    out = {r["page_id"]: r for r in url_filter.judge_urls(data).collect()}

    def rule(host, path):
        fits = [r for r in url_filter.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.name)) if fits else None

    for i, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            host, path = re.fullmatch(r"(?s)([^/?#]*)([^?#]*).*", u.split("://", 1)[1]).groups()
        own = rule(host.lower(), path)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host.lower(), path, own and own.name), u
        every = [p for p in url_filter.PATTERN_RULES if re.search(url_filter.pattern_regex(p), (u or "").lower())]
        allow = any(p.startswith("@@") for p in every) or not every
        assert out[i]["verdict"] == (own.action if own else "allow" if allow else "block"), u
    assert [out[i]["verdict"] for i in (12, 13, 14, 16, 17)] == ["block", "block", "allow", "allow", "block"]
    assert url_filter.judge_urls(data.where("false")).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    index = url_filter.rule_index(("/a/b^", "*cd*", "/a/"), {"a": 9, "b": 2})
    assert index == {"b": [0], "": [1], "a": [2]}


def test_ten_thousand_rules_equal_all_rules_on_all_urls(spark):
    words = [f"{a}{b}" for a in ("ad", "shop", "track", "promo", "img") for b in range(16)]
    rng = random.Random(7)
    shapes = ("/{a}/{b}^", "|http://{a}.{b}.", "*{a}{b}*", "^{a}={b}|", "@@/{a}/{b}/", "-{a}.{b}^", "/{a}/*/{b}.")
    rules = tuple(dict.fromkeys(rng.choice(shapes).format(a=rng.choice(words), b=rng.choice(words)) for _ in range(12_000)))
    assert len(rules) > 10_000
    ends = ("http://{a}.{b}.com/{c}", "http://x.com/{a}/{b}/{c}", "http://x.com/{a}/{c}/{b}.html", "http://Y.org/?q=1&{a}={b}",
            "http://z-{a}.{b}/", "http://x.com/{a}{b}{c}")
    urls = [rng.choice(ends).format(a=rng.choice(words).upper(), b=rng.choice(words), c=rng.choice(words)) for _ in range(400)]
    out = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), patterns=rules, host_rules=())
    out = {r["page_id"]: (r["verdict"], r["pattern"]) for r in out.collect()}
    every = [(p, re.compile(url_filter.pattern_regex(p))) for p in rules]
    seen = set()
    for i, u in enumerate(urls):
        hits = [p for p, r in every if r.search(u.lower())]
        first = next((p for p in hits if p.startswith("@@")), hits[0] if hits else None)
        assert out[i] == ("block" if first and not first.startswith("@@") else "allow", first), u
        seen.add(first and first.startswith("@@"))
    assert seen == {None, False, True}
