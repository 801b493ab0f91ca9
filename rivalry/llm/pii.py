"""Personal data spans: rules, overlapping candidates, boosted trees.

All of it is built-in DataFrame functions and Spark ML; no Python runs on the
executors.  Per text:

1. The four base rules (e-mail, IP address, payment card, phone) give spans that
   always stay.
2. High-recall generators propose further, overlapping candidates: obfuscated
   addresses, national phone formats, any long digit group, any dotted quad.
3. Gradient-boosted trees score each candidate on its format (lengths, digit
   groups, checksum, octets) and context (neighbouring characters, cue words).
   They learn from the candidates of all documents: those that a base rule
   confirms are positive, the others negative, and base finds rewritten in another
   format (no country code, spelled-out ``@``) are positive in their own
   surroundings.  One half of the candidates (by a hash) grows the trees.
4. A threshold per kind is set on the other, held-out half: the lowest score from
   which at least ``precision`` of the candidates are positive.  A kind without such a score adds nothing.
The trained trees are turned into one arithmetic expression and evaluated
inside the row, so texts are never exploded or shuffled.

Offsets are code points, ends exclusive.  Defined results: null text counts as
empty (no spans); repeated rows repeat their result; a table without candidates
of both classes adds nothing; an empty table gives no rows; extra columns are
carried by ``find_spans`` and ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, let

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.98

# The base rules in forms that Java matches without recursion; \G and the look-behind only skip starts that cannot match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?>\.[A-Za-z0-9-]++)++"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
DIGITS = r"[0-9](?>[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

# Generators besides the base patterns.
AT_WORD = r"[A-Za-z0-9._%+-]+\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]+(?:\x20?(?:\[dot\]|\(dot\)|\{dot\}|\.)\x20?[A-Za-z0-9-]+){1,6}"
LOCAL_PHONE = r"\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}"

CUES = {"cue_mail": r"(?i)mail|contact|write|inbox", "cue_phone": r"(?i)phone|tel|call|fax|mobil|cell|\+",
        "cue_card": r"(?i)card|visa|credit|payment|account", "cue_ip": r"(?i)\bip\b|host|server|client|login",
        "cue_other": r"(?i)version|release|isbn|order|serial|section|page|\bv\.?$|#$|=\s*\"?$"}
FEATURES = ["is_email", "is_ip", "is_card", "is_phone", "length", "digits", "letters", "blanks", "dots", "dashes",
            "parens", "luhn", "octets", "before_word", "after_word", "before_blank", "after_blank", *CUES]

SPAN = "array<struct<kind:int,s:int,e:int,h:string,l:string,r:string>>"


def _found(text: Column, pattern: str, kind: int, gate: Column | None = None) -> Column:
    """Matches as (kind, start, end, matched, 16 characters before, 8 after)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if gate is not None:
        hits = F.when(gate, hits).otherwise(F.array().cast("array<string>"))
    none = F.array().cast(SPAN)

    def placed(h: Column, parts: Column) -> Column:
        steps = F.transform(h, lambda x, i: F.struct(
            F.length(F.get(parts, i)).alias("g"), F.length(x).alias("n"), x.alias("h"),
            F.substring(F.get(parts, i), -16, 16).alias("l"), F.substring(F.get(parts, i + 1), 1, 8).alias("r")))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc, x):
            s = acc["at"] + x["g"]
            one = F.struct(F.lit(kind).alias("kind"), s.alias("s"), (s + x["n"]).alias("e"), x["h"].alias("h"),
                           x["l"].alias("l"), x["r"].alias("r"))
            return F.struct((s + x["n"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(steps, start, step, lambda acc: acc["out"])

    return let(hits, lambda h: F.when(F.size(h) > 0, let(F.split(text, pattern, -1), lambda p: placed(h, p))).otherwise(none))


def _digits(h: Column) -> Column:
    return F.regexp_replace(h, "[^0-9]", "")


def _luhn(h: Column) -> Column:
    def total(d):
        digit = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.struct(
            i.alias("i"), F.substr(F.reverse(d), i, F.lit(1)).cast("int").alias("v")))
        doubled = F.transform(digit, lambda x: F.when(x["i"] % 2 == 1, x["v"]).otherwise(
            x["v"] * 2 - F.when(x["v"] > 4, 9).otherwise(0)))
        return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0
    return let(_digits(h), lambda d: (F.length(d) > 0) & total(d))


def _ip_ok(h: Column) -> Column:
    return h.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds ``_base`` (base spans) and ``_cand`` (all generators' spans)."""
    t = F.coalesce(F.col("_t"), F.lit(""))
    df = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.select("*", _found(t, EMAIL, 0, F.contains(t, F.lit("@"))).alias("_email"), _found(t, IP, 1).alias("_ip"),
                   _found(t, DIGITS, 2).alias("_card"), _found(t, PHONE, 3, F.contains(t, F.lit("+"))).alias("_phone"),
                   _found(t, AT_WORD, 0, F.contains(t, F.lit("at]")) | F.contains(t, F.lit("at)")) | F.contains(t, F.lit("at}"))).alias("_at"),
                   _found(t, LOCAL_PHONE, 3).alias("_local"))
    n = F.length
    base = F.concat(F.col("_email"), F.filter("_ip", lambda x: _ip_ok(x["h"])),
                    F.filter("_card", lambda x: n(_digits(x["h"])).between(14, 19) & _luhn(x["h"])),
                    F.filter("_phone", lambda x: n(_digits(x["h"])).between(10, 15)))
    cand = F.concat(F.col("_email"), F.col("_at"), F.col("_ip"),
                    F.filter("_card", lambda x: n(_digits(x["h"])).between(12, 19)),
                    F.filter("_phone", lambda x: n(_digits(x["h"])) >= 7),
                    F.filter("_local", lambda x: n(_digits(x["h"])).between(7, 15)))
    return df.select("*", base.alias("_base"), cand.alias("_cand")).drop("_t", "_email", "_ip", "_card", "_phone", "_at", "_local")


def features(x: Column) -> dict[str, Column]:
    """Numeric features of a candidate struct."""
    h, left, right = x["h"], x["l"], x["r"]
    f = {f"is_{k}": (x["kind"] == i).cast("double") for i, k in enumerate(KINDS)}
    f["length"] = F.length(h)
    f["digits"] = F.length(_digits(h))
    f["letters"] = F.length(F.regexp_replace(h, "[^A-Za-z]", ""))
    for name, chars in (("blanks", " "), ("dots", "."), ("dashes", "-"), ("parens", "()")):
        f[name] = F.length(h) - F.length(F.translate(h, chars, ""))
    f["luhn"], f["octets"] = _luhn(h), _ip_ok(h)
    f["before_word"], f["after_word"] = left.rlike("[A-Za-z0-9]$"), right.rlike("^[A-Za-z0-9]")
    f["before_blank"], f["after_blank"] = left.rlike(r"(^|\s)$"), right.rlike(r"^(\s|$|[.,;])")
    f |= {name: left.rlike(p) for name, p in CUES.items()}
    return {name: f[name].cast("double") for name in FEATURES}


@dataclass
class Trees:
    """Boosted trees as nested tuples (feature, threshold, left, right) or leaf values."""
    trees: list
    weights: list
    thresholds: list  # by kind; above 1: add nothing

    def score(self, f: dict[str, Column]) -> Column:
        def walk(t):
            if not isinstance(t, tuple):
                return F.lit(float(t))
            return F.when(f[FEATURES[t[0]]] <= t[1], walk(t[2])).otherwise(walk(t[3]))
        margin = sum((walk(t) * w for t, w in zip(self.trees, self.weights)), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def _unpack(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    s = node.split()
    return (s.featureIndex(), s.threshold(), _unpack(node.leftChild()), _unpack(node.rightChild()))


def training_rows(docs: DataFrame) -> DataFrame:
    """(x, label): candidates of all documents, and of base finds rewritten in
    another format."""
    spans = with_spans(docs.select(F.col("text").cast("string"))).select("_base", "_cand")
    marked = cut_lineage(spans.where(F.size("_cand") + F.size("_base") > 0), "pii-candidates")

    def labelled(df):
        same = F.exists("_base", lambda b: (b["kind"] == F.col("x.kind")) & (b["s"] == F.col("x.s")) & (b["e"] == F.col("x.e")))
        inside = F.exists("_base", lambda b: (b["s"] <= F.col("x.s")) & (b["e"] >= F.col("x.e")))
        df = df.select("_base", F.explode("_cand").alias("x")).select("x", same.alias("label"), inside.alias("inside"))
        return df.where("label OR NOT inside").select("x", F.col("label").cast("double").alias("label"))

    found = marked.select(F.explode("_base").alias("b"))
    spelled = F.concat(F.substring_index("b.h", "@", 1), F.lit(" [at] "),
                       F.regexp_replace(F.substring_index("b.h", "@", -1), r"\.", " [dot] "))
    other = F.when(F.col("b.kind") == 0, spelled).when(
        F.col("b.kind") == 3, F.regexp_replace("b.h", r"^\+[0-9]{1,3}[ .-]*", ""))
    rewritten = found.where("b.kind IN (0, 3)").select(
        F.col("b.kind").alias("kind"), F.length("b.l").alias("at"), other.alias("h"),
        F.concat(F.regexp_replace("b.l", "[+]", " "), other, F.col("b.r")).alias("text"))
    rewritten = with_spans(rewritten).where("h <> ''").select("kind", "at", F.length("h").alias("n"), F.explode("_cand").alias("x"))
    covers = (F.col("x.kind") == F.col("kind")) & (F.abs(F.col("x.s") - F.col("at")) <= 1) & (
        F.abs(F.col("x.e") - F.col("at") - F.col("n")) <= 1)
    return labelled(marked).unionByName(rewritten.select("x", covers.cast("double").alias("label")))


def train(docs: DataFrame, precision: float = PRECISION) -> Trees | None:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = training_rows(docs)
    f = features(F.col("x"))
    rows = rows.select("label", F.col("x.kind").alias("kind"), F.pmod(F.xxhash64("x"), F.lit(2)).alias("half"),
                       *[f[n].alias(n) for n in FEATURES])
    rows = cut_lineage(rows, "pii-rows")
    classes = rows.where("half = 0").groupBy("label").count().count()
    if classes < 2:
        return None
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.where("half = 0"))
    model = GBTClassifier(maxIter=8, maxDepth=3, maxBins=16, seed=7).fit(data)
    trees = Trees([_unpack(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights), [2.0] * len(KINDS))
    cols = {n: F.col(n) for n in FEATURES}
    bins = (rows.where("half = 1").select("kind", "label", F.floor(trees.score(cols) * 100).alias("bin"))
            .groupBy("kind", "bin").agg(F.count("*").alias("n"), F.sum("label").alias("hit")).collect())  # at most 4 x 101 rows
    for kind in range(len(KINDS)):
        n = hit = 0.0
        for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
            n, hit = n + r["n"], hit + r["hit"]
            if hit < precision * n:
                break
            trees.thresholds[kind] = r["bin"] / 100
    return trees


def find_spans(docs: DataFrame, model: Trees | None) -> DataFrame:
    """Adds ``_base`` and ``_spans``: base spans and the candidates that the
    model selects, no selected candidate overlapping a base span or a selected
    one of a higher score (then earlier start, longer, kind as listed)."""
    df = with_spans(docs)
    if model is None:
        added = F.array().cast("array<struct<kind:int,s:int,e:int>>")
        df = df.withColumn("_added", added)
    else:
        limits = F.array(*[F.lit(float(t)) for t in model.thresholds])
        fresh = F.filter("_cand", lambda x: ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
        df = df.withColumn("_fresh", fresh)
        scored = F.transform("_fresh", lambda x: F.struct(
            (-model.score(features(x))).alias("p"), x["s"].alias("s"), (-x["e"]).alias("ne"), x["kind"].alias("kind")))
        df = df.withColumn("_scored", F.array_sort(F.array_distinct(F.filter(scored, lambda x: -x["p"] >= F.get(limits, x["kind"])))))

        def add(acc, x):
            clash = F.exists(acc, lambda a: (a["s"] < -x["ne"]) & (a["e"] > x["s"]))
            one = F.struct(x["kind"].alias("kind"), x["s"].alias("s"), (-x["ne"]).alias("e"))
            return F.when(clash, acc).otherwise(F.concat(acc, F.array(one)))

        empty = F.array().cast("array<struct<kind:int,s:int,e:int>>")
        df = df.withColumn("_added", F.aggregate("_scored", empty, add)).drop("_fresh", "_scored")
    order = lambda spans: F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))
    return (df.withColumn("_base", order(F.col("_base")))
            .withColumn("_spans", F.array_sort(F.concat(F.col("_base"), order(F.col("_added"))))).drop("_cand", "_added"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")


def pii_digest(docs: DataFrame, model: Trees | None) -> DataFrame:
    df = find_spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)
    def count(kind: int) -> Column:
        return F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return df.select("doc_id", *map(count, range(len(KINDS))), F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, model: Trees | None) -> DataFrame:
    """``docs`` with each span of its text replaced by ``<KIND>``; overlapping
    spans give one tag, the first one's."""
    columns = docs.columns
    df = find_spans(docs, model)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("any"), F.array().cast("array<struct<s:int,e:int,kind:int>>").alias("out"))

    def step(acc, x):
        clash = acc["any"] & (x["s"] < acc["at"])
        one = F.struct(F.greatest(x["s"], acc["at"]).alias("s"), F.greatest(x["e"], acc["at"]).alias("e"),
                       F.when(clash, -1).otherwise(x["kind"]).alias("kind"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.lit(True).alias("any"), F.concat(acc["out"], F.array(one)).alias("out"))

    df = df.withColumn("_spans", F.aggregate("_spans", start, step, lambda a: a["out"]))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    size = F.size("_spans")
    # the text between spans k-1 and k, each followed by the tag of span k
    pieces = F.transform("_spans", lambda x, i: F.concat(
        F.substr(F.col("text"), F.when(i == 0, 0).otherwise(F.get(F.col("_spans"), i - 1)["e"]) + 1,
                 x["s"] - F.when(i == 0, 0).otherwise(F.get(F.col("_spans"), i - 1)["e"])),
        F.when(x["kind"] < 0, "").otherwise(F.get(names, F.greatest(x["kind"], F.lit(0))))))
    tail = F.substr(F.col("text"), F.get(F.col("_spans"), size - 1)["e"] + 1, F.length("text"))
    text = F.when(size > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    return df.withColumn("text", text).select(*columns)
