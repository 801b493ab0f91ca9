"""Quality, PII, licences, language ID: base counts by brute force, methods by behaviour."""

import collections
import hashlib
import random
import re
import zlib

import pytest

import __spark_entry__ as E
from conftest import SF_MED, SF_SMALL, duck
from llm_rows import docs, odd_docs  # noqa: F401
from rivalry.llm import langid, licenses, pii
from rivalry.llm.quality import js_distance, quality

KINDS = ["email", "ip", "card", "phone"]


def texts_of(sf):
    return dict(duck(sf).execute("SELECT doc_id, text FROM documents").fetchall())


def quality_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = list(zip(w, w[1:], w[2:]))
    count, inside = collections.Counter(tri), set()
    for i, t in enumerate(tri):
        if count[t] > 1:
            inside |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside),
            len(w) < 50 or 100 * len(inside) > 50 * len(w))


QUALITY = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_query_op2(spark):
    text = texts_of(SF_SMALL)
    rows = E.queries()["op2_quality_divergence"](spark, SF_SMALL).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert tuple(r[c] for c in QUALITY) == quality_base(text[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_quality_odd_and_random(spark, odd_docs, docs):
    assert quality(odd_docs).count() == odd_docs.count() and quality(odd_docs.limit(0)).count() == 0
    rng = random.Random(1)
    rows = [(n, "".join(rng.choices(["a", "b", " ", "\n", "\t", "é#", "THE"], k=rng.randint(0, 80))), rng.choice(["en", None, "zz"])) for n in range(400)]
    want = {i: quality_base(t) for i, t, _ in rows}
    for r in quality(docs(rows)).collect():
        assert tuple(r[c] for c in QUALITY) == want[r["doc_id"]] and r["kept"] is not None


def test_divergence_rejects_what_differs(spark, docs):
    rng = random.Random(2)
    good = [f"{a}{b}{c}" for a in "bcdfglmnpr" for b in ("ade", "one", "ute", "ish") for c in ("", "s", "ly", "ing")]

    def prose():
        return " ".join(rng.choice([rng.choice(["the", "of", "and", "to", "in"]), rng.choice(good), rng.choice(good)]) for _ in range(300)) + "."

    rows = [(n, prose(), "en") for n in range(200)]
    rows += [(900, " ".join(w + "###" for w in prose().split()), "en"), (901, prose().upper(), "en"),
             (902, " ".join(f"{rng.randrange(10 ** 6)}" for _ in range(300)), "en")]
    kept = {r["doc_id"]: r["kept"] for r in quality(docs(rows)).collect()}
    assert all(kept[n] for n in range(200)) and not any(kept[n] for n in (900, 901, 902))


def test_every_language_has_its_own_reference(spark, docs):
    """70 languages of disjoint words: whichever is judged, its clean documents stay, as when it is alone."""
    rng = random.Random(6)

    def prose(k, short=True):
        a, b = chr(97 + k % 26), chr(97 + k // 26)
        common = [f"{a}{b}{c}" for c in "xyz"] if short else []
        rare = [f"{a}{c}{b}{d}{e}ngen" for c in "aeiou" for d in "lmnrst" for e in "aeiou"]
        return " ".join(rng.choice([rng.choice(common or rare), rng.choice(rare), rng.choice(rare)]) for _ in range(300)) + "."

    rows = [(100 * k + n, prose(k), f"l{k:02}") for k in range(70) for n in range(3 if k == 69 else 4)]
    rows += [(9000 + n, prose(30, short=False), "no short words") for n in range(3)]
    got = {r["doc_id"]: tuple(r) for r in quality(docs(rows)).collect()}
    assert all(r[7] for r in got.values())
    for lang in ("l69", "no short words"):
        alone = quality(docs([r for r in rows if r[2] == lang])).collect()
        assert len(alone) == 3 and all(tuple(r) == got[r["doc_id"]] for r in alone)


def test_a_document_is_no_part_of_its_own_reference(spark, docs):
    rng = random.Random(3)
    long = [f"{a}{b}ngen" for a in "bcdfglmnprst" for b in ("ade", "one", "ute", "ish", "ela")]
    prose = [" ".join(rng.choice([rng.choice(["the", "of", "and", "to", "in"]), rng.choice(long), rng.choice(long)]) for _ in range(300)) for _ in range(40)]
    junk = " ".join("".join(rng.choices("#*$%&|<>0123456789", k=6)) for _ in range(300))
    rows = [(i, t, "en") for i, t in enumerate(prose)] + [(100, junk, "xx"), (101, prose[0], "yy"), (102, junk, "zz"), (103, None, "zz"), (104, "", "yy")]
    got = {r["doc_id"]: r for r in quality(docs(rows)).collect()}
    # alone in its language: judged by all other documents
    assert not got[100]["kept"] and got[100]["char_js"] > 0.5 and not got[102]["kept"] and got[101]["kept"]
    alone = quality(docs([(1, prose[0], "en")])).first()
    assert (alone["char_js"], alone["word_js"], alone["kept"]) == (None, None, True)


def test_js_distance_bounds(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([([0.5, 0.2], [0.5, 0.2]), ([1.0, 0.0], [0.0, 1.0])], "p array<double>, q array<double>")
    same, apart = [r[0] for r in df.select(js_distance(F.col("p"), F.col("q"))).collect()]
    assert same == pytest.approx(0, abs=1e-7) and apart == pytest.approx(1)


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(v) <= 255 for v in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def pii_row(text):
    o = base_spans(text)
    return (*[sum(k == j for _, k, _ in o) for j in range(4)], hashlib.sha256(joined(o).encode()).hexdigest())


def check_pii(rows, text):
    for r in rows:
        t = text[r["doc_id"]]
        assert tuple(r[1:6]) == pii_row(t)
        spans = [s for s in r["spans"].split(",") if s]
        assert set(joined(base_spans(t)).split(",")) - {""} <= set(spans)
        order = [(int(s.split(":")[1]), KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.train(spark.read.parquet(f"{SF_MED}/documents.parquet"))


def test_query_op5(spark):
    text = texts_of(SF_SMALL)
    rows = E.queries()["op5_pii_boosted"](spark, SF_SMALL).collect()
    assert len(rows) == len(text)
    check_pii(rows, text)


def test_pii_random_texts(spark, docs, pii_model):
    rng = random.Random(0)
    parts = ["a", "@", "b.c", ".", "1", "22", "4111 1111 1111 1111", "+1 (535) 555-5412", " ", "x.y@z-1.co.uk", "10.0.0.1",
             "999.1.1.1", "é", "+", "-", "%", "007.08.1.255.3", "378282246310005", "joe [at] ex [dot] com", "(212) 555-0199"]
    rows = [(n, "".join(rng.choices(parts, k=rng.randint(0, 14))), None) for n in range(1500)] + [(9001, None, None), (9002, "", "en")]
    df, text = docs(rows), {i: t for i, t, _ in rows}
    found = pii.pii_digest(df, pii_model).collect()
    check_pii(found, text)
    spans = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s] for r in found}
    for r in pii.redact(df, pii_model).collect():
        t = text[r["doc_id"]]
        if t is None:
            assert r["text"] is None
            continue
        out, at, begun = "", 0, False
        for k, s, e in spans[r["doc_id"]]:
            if not (begun and int(s) < at):
                out += t[at:int(s)] + f"<{k.upper()}>"
            at, begun = max(at, int(e)), True
        assert r["text"] == out + t[at:]


def test_pii_trees_add_other_formats(spark, docs, pii_model):
    text = "Please write to joe.doe [at] mail1 [dot] example [dot] com or call (212) 555-0199 today, order 12 of 30."
    spans = pii.pii_digest(docs([(1, text, "en")]), pii_model).first()["spans"]
    assert spans == f"email:16:{text.index(' or call')},phone:{text.index('(212')}:{text.index(' today')}"


def test_pii_learns_from_every_document(spark):
    docs = spark.range(24_000).selectExpr("id AS doc_id", "concat('Write to user', id, '@mail.example.com today') AS text")
    rows = pii.training_rows(docs).where("label = 1 AND contains(x.h, '@')")
    assert rows.select("x.h").distinct().count() == 24_000


def test_pii_long_and_odd(spark, docs, odd_docs, pii_model):
    rows = [(1, "1" * 50000, None), (2, "1 2-" * 10000, None), (3, "a@" + "a.b-" * 10000, None), (4, "+1" + " ()5" * 10000, None)]
    check_pii(pii.pii_digest(docs(rows), pii_model).collect(), {i: t for i, t, _ in rows})
    assert pii.pii_digest(odd_docs, pii_model).count() == odd_docs.count()
    assert pii.pii_digest(odd_docs, None).count() == odd_docs.count()
    assert pii.train(odd_docs.limit(0)) is None
    assert pii.redact(odd_docs, pii_model).columns == odd_docs.columns


def test_query_op3_accuracy(spark):
    lang = dict(duck(SF_MED).execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = E.queries()["op3_string_kernel_langid"](spark, SF_MED).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_langid_learns_only_from_the_training_rows(spark, docs):
    rows = [(n, "aaa bbb ccc " * 5, "held" if zlib.crc32(str(n).encode()) % 5 == 0 else None) for n in range(50)]
    assert langid.train(docs(rows)) is None
    rows += [(100 + n, "xyz yzx " * 5, "xx") for n in range(30)] + [(200 + n, "mno nom " * 5, "mm") for n in range(30)]
    model = langid.train(docs(rows))
    assert model.langs == ["mm", "xx"]
    got = {r["text"]: r["lang_pred"] for r in langid.predict(docs([(1, "nom mno", None), (2, "12 ?", "en"), (3, None, "en"), (4, "ZYX xyz", "mm")]), model).collect()}
    assert got == {"nom mno": "mm", "12 ?": "und", None: "und", "ZYX xyz": "xx"}


def test_langid_learns_every_language(spark, docs):
    """300 languages of a few letters each, known from their own letters."""
    pairs = [a + b for a in "abcdefghijklmnopqr" for b in "abcdefghijklmnopqr" if a != b][:300]
    ids = iter(n for n in range(10 ** 6) if zlib.crc32(str(n).encode()) % 5)
    model = langid.train(docs([(next(ids), f"{p} {p}{p} " * 9, f"l-{p}") for p in pairs for _ in range(1 if p == pairs[-1] else 2)]))
    assert model.langs == sorted(f"l-{p}" for p in pairs)
    got = [r["lang_pred"] for r in langid.predict(docs([(1, f"{pairs[-1]} " * 9, None)]), model).collect()]
    assert got == [f"l-{pairs[-1]}"]


def test_langid_trains_on_the_whole_text(spark, docs):
    """Texts with a letterless or foreign head teach the language of what follows."""
    ids = [n for n in range(300) if zlib.crc32(str(n).encode()) % 5]
    rows = [(n, "12 ? " * 2000 + "xyz yzx zxy " * 2000, "xx") for n in ids[:60]]
    rows += [(n, "qrs rsq " * 1100 + "mno nom omn " * 4000, "mm") for n in ids[60:120]]
    texts = [r["text"] for r in langid.training_sample(docs(rows)) if r["lang"] == "xx"]
    assert len(texts) == 60 and all("xyz" in t for t in texts)
    heads = [r["text"].startswith("qrs") for r in langid.training_sample(docs(rows)) if r["lang"] == "mm"]
    assert sum(heads) < 30
    got = langid.predict(docs([(1, "xyz zxy", None), (2, "mno omn", None)]), langid.train(docs(rows)))
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "xx", 2: "mm"}


def test_langid_odd_rows(spark, odd_docs):
    model = langid.train(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    out = langid.predict(odd_docs, model)
    assert out.count() == odd_docs.count() and "words" in out.columns
    assert langid.language_digest(odd_docs, None).where("lang_pred <> 'und'").count() == 0
    assert langid.language_digest(odd_docs.limit(0), model).count() == 0


def test_query_op1_finds_the_notices(spark):
    text = texts_of(SF_MED)
    marks = {"apache-2.0": "Apache License", "gpl": "GNU General", "mit": "MIT License", "cc-by-nc": "CC BY-NC"}
    rows = E.queries()["op1_license_classifier"](spark, SF_MED).collect()
    assert len(rows) == len(text)
    for r in rows:
        t = text[r["doc_id"]]
        assert r["families"] == ",".join(sorted(f for f, m in marks.items() if m in t))
        assert r["n_paragraphs"] == sum(bool(x.strip(" \t\n\x0b\f\r")) for x in t.split("\n"))


def test_licenses_every_template_and_inside_long_lines(spark, docs):
    """Each template is found alone, and the short ones inside a line of other words."""
    for units in (licenses.template_units(t) for f in licenses.FAMILIES for t in licenses.TEMPLATES[f]):
        bare = [u for u in units if not any(c in w for w in u for c in licenses.CUES)]
        assert len(bare) < licenses.units_needed(len(units))
    train = spark.read.parquet(f"{SF_MED}/documents.parquet")
    model = licenses.train(train)
    noise = " ".join(train.where("length(text) > 3000").orderBy("doc_id").first()["text"].split()[:300]).split()
    noise = " ".join(w for w in noise if not any(c in w.lower() for c in licenses.CUES))
    alone = [(f, t) for f in licenses.FAMILIES for t in licenses.TEMPLATES[f]]
    inside = [("mit", "Released under the MIT License."), ("bsd", "Released under the BSD License."), ("cc-by", "Licensed under CC BY 4.0."),
              ("public-domain", "Released under CC0 1.0 Universal."), ("mit", "SPDX-License-Identifier: MIT")]
    cases = alone + [(f, f"{noise} {t} {noise}") for f, t in inside]
    out = {r["doc_id"]: r["families"] for r in licenses.scan(docs([(k, t, None) for k, (_, t) in enumerate(cases)]), model).collect()}
    assert {k: out[k] for k, (f, _) in enumerate(cases) if out[k] != f} == {}


def test_licenses_of_other_wordings(spark, docs):
    """Wordings no template confirms: the classifier names the family or says unknown; clean sentences stay unknown."""
    train = spark.read.parquet(f"{SF_MED}/documents.parquet")
    model = licenses.train(train)
    noise = [x["text"].split("\n")[0][:200] for x in train.where("length(text) > 400").orderBy("doc_id").limit(12).collect()]
    planted = [("gpl", "This tool is distributed under GPLv3."), ("gpl", "License: GPL v3"), ("agpl", "The server is licensed under the GNU AGPL, version 3."),
               ("apache-2.0", "Available under Apache Licence 2."), ("bsd", "Use of this file is governed by a BSD-style license."), ("isc", "The parser is ISC licensed."),
               ("mit", "The code is MIT licensed, see below."), ("epl", "It comes under the Eclipse Public Licence."), ("lgpl", "This library is distributed under LGPLv3 terms."),
               ("mpl-2.0", "This file is covered by the Mozilla Public Licence."), ("cc-by-nc", "Pictures: Creative Commons, non-commercial."), ("bsl-1.0", "Subject to the Boost Software Licence.")]
    clean = ["His driving licence was checked twice.", "The licence fee is due in May.", "They bought a fishing license by the lake.", "License plates are made here.",
             "The club lost its licence to sell drinks.", "A licensed doctor came.", "Copyright is a branch of law.", "The public domain was debated for hours."]
    rows = [(k, f"{noise[k % 12]}\n{t}\n{noise[(k + 1) % 12]}", None) for k, (_, t) in enumerate(planted)]
    rows += [(100 + k, f"{noise[k % 12]}\n{t}", None) for k, t in enumerate(clean)]
    out = {r["doc_id"]: r for r in licenses.scan(docs(rows), model).collect()}
    right = sum(f in (out[k]["likely"] + "," + out[k]["families"]).split(",") for k, (f, _) in enumerate(planted))
    wrong = sum(bool(out[k]["likely"]) and planted[k][0] not in out[k]["likely"].split(",") for k in range(len(planted)))
    assert right >= 10 and wrong <= 1
    assert sum(r["n_license"] + r["n_likely"] for k, r in out.items() if k >= 100) <= 1
    assert all(r["n_cue"] >= 1 for r in out.values())


def test_licenses_belong_to_rows(spark, docs):
    model = licenses.train(spark.read.parquet(f"{SF_MED}/documents.parquet"))
    mit, gpl = "Released under the MIT License.", "Released under the GNU General Public License, version 2 or later."
    rows = [(None, mit, None), (None, "a\nb", None), (4, gpl, None), (4, "plain", None), (4, gpl, None), (5, f"{mit}\n{'word ' * 3000}{gpl}\n{mit}", None)]
    got = sorted(((r["doc_id"], r["n_paragraphs"], r["n_license"], r["families"]) for r in licenses.scan(docs(rows), model).collect()), key=repr)
    assert got == sorted([(None, 1, 1, "mit"), (None, 2, 0, ""), (4, 1, 1, "gpl"), (4, 1, 0, ""), (4, 1, 1, "gpl"), (5, 3, 3, "gpl,mit")], key=repr)


def test_licenses_unknown_and_odd(spark, docs, odd_docs):
    model = licenses.train(spark.read.parquet(f"{SF_MED}/documents.parquet"))
    rows = [(k, t, None) for k, t in enumerate(licenses.UNKNOWN)] + [(100, "He has the license to use the word.", None)]
    assert licenses.scan(docs(rows), model).where("n_license > 0").count() == 0
    new = [(1, "Copyright 2021 X\nThis software is released under the MIT License.", None), (2, "Source available under the Mozilla Public License, version 2.0", None)]
    assert {r["doc_id"]: r["families"] for r in licenses.scan(docs(new), model).collect()} == {1: "mit", 2: "mpl-2.0"}
    assert licenses.scan(odd_docs, model).count() == odd_docs.count()
    assert licenses.scan(odd_docs.limit(0), model).count() == 0
