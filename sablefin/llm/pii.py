"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose candidates: strict ones (kinds email, ip, card, phone: the base, which stays) and
loose ones (numbers without a country code, obfuscated addresses, social security numbers, account
numbers, titled names, failed cards and addresses). Four labelers vote on each candidate with -1, 0
or 1: its shape, a gazetteer, the words before it, and its edges. Counts by kind and votes (at most
kinds * 3**4 rows, whatever the corpus) go to the driver, where expectation-maximisation estimates
each labeler's reliability and a logistic span classifier is fitted to the posterior labels. The
classifier then decides every candidate outside the base in the JVM. One that fails its kind's own check
(Luhn, parts, number of digits) is evidence for the model but no finding: it is not personal data of that
kind, whatever stands about it. Of added spans that overlap the first, then the longest, stays.

Defined cases: null and empty texts have no spans; positions are code points; without candidates
there is no model and nothing is added; repeated rows give repeated results; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablefin.llm.native import SPAN, let, located, luhn, parts_of, ranked, searchable, written
from sablefin.llm.shared import materialise, table

LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
LOOSE = {
    "phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "email": rf"[{LOCAL}]{{1,64}}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z0-9-]++)++",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?",
}
KINDS = (*BASE, "ssn", "iban", "name")
WORTH = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]",
    "loose phone": r"[0-9]{3}[.-][0-9]{4}", "loose email": r"[(\[]at[)\]]", "loose ssn": r"[0-9]{3}-[0-9]{2}-", "loose iban": r"[A-Z]{2}[0-9]{2}", "loose name": r"(?:Mr|Ms|rs|Dr|of)\.?\x20[A-Z]",
}
TLDS = "com|org|net|edu|gov|io|de|fr|es|it|uk|eu|info|biz|us|ca|au|jp|cn|ch|at|nl|be|se|no|dk|fi|pl|pt|ru|br|in|mx"
COUNTRIES = "AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR"
GIVEN = "Anna|Anne|Bob|Carlos|Charles|David|Elena|Emma|Hans|James|Jane|Jean|John|Jose|Julia|Karl|Laura|Luis|Maria|Marie|Mark|Mary|Michael|Paul|Peter|Pierre|Robert|Sarah|Thomas|William"
NEAR = r"(?i)(?:phone|tel|call|mobile|fax|mail|contact|reach|card|visa|iban|ssn|social|account|address|server|host|\bip\b|write to|dear|signed)[^\n]{0,25}$"
FAR = r"(?i)(?:version|isbn|order|invoice|page|chapter|build|serial|part no)[^\n]{0,15}$|[$€£]\x20?$"
VOTERS = ("shape", "gazetteer", "context", "edges")
CANDIDATE = "array<struct<s:int,e:int,t:string,before:string,after:string>>"


def candidates(text: Column, regex: str, worth: str) -> Column:
    """Matches with up to 40 characters before each and one after."""

    def cut(parts):
        return let(located(parts), lambda found: F.transform(found, lambda x, j: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), F.right(F.get(parts, 2 * j), F.lit(40)).alias("before"), F.left(F.get(parts, 2 * j + 2), F.lit(1)).alias("after"))))

    return F.when(text.rlike(worth), let(parts_of(text, regex), cut)).otherwise(F.array().cast(CANDIDATE))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def octets_fit(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: F.when(F.length(q) > 3, F.lit(False)).otherwise(q.cast("int") <= 255)))


def passes(kind: str, x: Column) -> Column:
    if kind == "ip":
        return octets_fit(x)
    if kind == "card":
        return let(digits(x), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(x)).between(9, 15)
    return F.lit(True)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, strict: bool, x: Column) -> list[Column]:
    t, never = x["t"], F.lit(False)
    shape = passes(kind, t) if strict or kind in ("card", "ip") else F.lit(True)
    known = {
        "email": vote(t.rlike(rf"(?i)[.)\]]\x20?(?:{TLDS})$"), never),
        "ip": vote(t.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."), t.rlike(r"^(?:0|127|22[4-9]|2[3-9][0-9])\.")),
        "card": vote(digits(t).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"), ~digits(t).rlike("^[3-6]")),
        "phone": vote(digits(t).rlike("^(?:1|3[0-9]|4[0-9]|[2-9][0-9]{2}[2-9])"), digits(t).rlike("^0{3}")),
        "ssn": vote(~t.rlike("^(?:000|666|9)"), t.rlike("^(?:000|666|9)")),
        "iban": vote(t.rlike(f"^(?:{COUNTRIES})"), ~t.rlike(f"^(?:{COUNTRIES})")),
        "name": vote(t.rlike(rf"\b(?:{GIVEN})\b"), never),
    }[kind]
    edges = vote(~F.right(x["before"], F.lit(1)).rlike(r"[\p{L}\p{N}.,]") & ~x["after"].rlike(r"[\p{L}\p{N}]"), x["after"].rlike(r"[\p{L}\p{N}]") | F.right(x["before"], F.lit(1)).rlike(r"[\p{L}\p{N}]"))
    return [vote(shape, ~shape), known, vote(x["before"].rlike(NEAR), x["before"].rlike(FAR)), edges]


def judged(found: Column, kind: str, strict: bool) -> Column:
    """Candidates with kind, votes, and whether they belong to the base."""

    def one(x):
        given = votes(kind, strict, x)
        return F.struct(
            x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), x["e"].alias("e"),
            (passes(kind, x["t"]) if strict else F.lit(False)).alias("base"), *[v.cast("int").alias(n) for v, n in zip(given, VOTERS, strict=True)],
        )

    return F.transform(found, one)


def candidate_table(docs: DataFrame) -> DataFrame:
    """doc_id and all its candidates, base and loose; loose ones that touch a base span are left out."""
    text = docs.select("doc_id", searchable(F.col("text")).alias("t"))
    strict = dict(zip(BASE, (EMAIL, IP, CARD, PHONE), strict=True))
    raw = text.select(
        "doc_id",
        *[candidates(F.col("t"), rx, WORTH[k]).alias(k) for k, rx in strict.items()],
        *[candidates(F.col("t"), rx, WORTH[f"loose {k}"]).alias(f"loose_{k}") for k, rx in LOOSE.items()],
    )
    # A strict match of the card pattern is any run of digits: only those of card length are candidates at all.
    raw = raw.withColumn("card", F.filter("card", lambda x: F.length(digits(x["t"])).between(12, 19)))
    strict_all = F.concat(*[judged(F.col(k), k, True) for k in BASE])
    loose_all = F.concat(*[judged(F.col(f"loose_{k}"), k, False) for k in LOOSE])
    found = raw.select("doc_id", strict_all.alias("strict"), loose_all.alias("loose"))
    base = found.select("doc_id", "loose", F.filter("strict", lambda x: x["base"]).alias("base"), F.filter("strict", lambda x: ~x["base"]).alias("failed"))
    others = F.filter(F.concat("failed", "loose"), lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return base.select("doc_id", "base", others.alias("others"))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict, dict, dict]:
    """EM over vote patterns: P(vote | label) of each labeler, prior of each kind, posterior of each pattern.

    Starts from the majority of votes; all counts are smoothed, so the result exists for any input.
    """
    post = {(k, v): 1 / (1 + math.exp(-1.5 * sum(v))) for k, v, _ in patterns}
    table_, prior = {}, {}
    for _ in range(rounds):
        count = {(i, y, x): 1.0 + (y == (x + 1) // 2 and x != 0) for i in range(len(VOTERS)) for y in (0, 1) for x in (-1, 0, 1)}
        mass = {k: [1.0, 1.0] for k in KINDS}
        for k, v, n in patterns:
            p = post[k, v]
            mass[k][0] += n * (1 - p)
            mass[k][1] += n * p
            for i, x in enumerate(v):
                count[i, 1, x] += n * p
                count[i, 0, x] += n * (1 - p)
        table_ = {(i, y, x): c / sum(count[i, y, z] for z in (-1, 0, 1)) for (i, y, x), c in count.items()}
        prior = {k: m[1] / sum(m) for k, m in mass.items()}
        for k, v, _ in patterns:
            odds = math.log(prior[k] / (1 - prior[k])) + sum(math.log(table_[i, 1, x] / table_[i, 0, x]) for i, x in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
    return table_, prior, post


def span_classifier(patterns, post, rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> dict:
    """Logistic regression on kind and votes, fitted to the posterior labels."""
    weight: dict = {}
    total = sum(math.sqrt(n) for _, _, n in patterns) or 1.0
    for _ in range(rounds):
        slope: dict = {}
        for k, v, n in patterns:
            names = [("kind", k), *[(i, x) for i, x in enumerate(v)]]
            z = sum(weight.get(name, 0.0) for name in names)
            miss = post[k, v] - 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
            for name in names:
                slope[name] = slope.get(name, 0.0) + math.sqrt(n) * miss / total
        for name, s in slope.items():
            weight[name] = weight.get(name, 0.0) * (1 - decay) + rate * s
    return weight


def accepted(weight: dict):
    """The classifier as a test of a candidate; without a model nothing is accepted."""

    def test(x):
        z = F.lit(0.0)
        for i, name in enumerate(VOTERS):
            for value in (-1, 0, 1):
                z = z + F.when(x[name] == value, F.lit(weight.get((i, value), 0.0))).otherwise(F.lit(0.0))
        for kind in KINDS:
            z = z + F.when(x["kind"] == kind, F.lit(weight.get(("kind", kind), -9.0))).otherwise(F.lit(0.0))
        return (z > 0) & (x["shape"] > 0)

    return test


def apart(spans: Column) -> Column:
    """Of spans that overlap, the one that starts first; of those, the longest, then the first by kind."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("back"), x["k"].alias("k"), x["kind"].alias("kind"), x["e"].alias("e"))))
    zero = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<s:int,k:int,kind:string,e:int>>").alias("out"))

    def step(acc, x):
        kept = F.struct(x["e"].alias("end"), F.concat(acc["out"], F.array(F.struct(x["s"].alias("s"), x["k"].alias("k"), x["kind"].alias("kind"), x["e"].alias("e")))).alias("out"))
        return F.when(x["s"] >= acc["end"], kept).otherwise(acc)

    return F.aggregate(order, zero, step, lambda acc: acc["out"])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and added spans; added ones touch neither a base span nor each other."""
    found = materialise(candidate_table(docs), "pii")
    flat = found.select(F.explode(F.concat("base", "others")).alias("x")).groupBy("x.kind", *[f"x.{v}" for v in VOTERS]).agg(F.count("*").alias("n"))
    patterns = sorted((r["kind"], tuple(r[v] for v in VOTERS), r["n"]) for r in flat.collect())
    _, _, post = reliabilities(patterns)
    return found.select("doc_id", "base", F.when(F.size("others") > 0, apart(F.filter("others", accepted(span_classifier(patterns, post))))).otherwise(F.array()).alias("added"))


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda column: F.transform(column, lambda x: F.struct(x["s"], x["k"], x["kind"], x["e"]))
    spans = find_pii(table(spark, sf_dir, "documents")).select(
        "doc_id", F.array_sort(pick("base")).alias("base"), F.array_sort(F.concat(pick("base"), pick("added"))).alias("all"), F.size("added").cast("long").alias("n_added"),
    )
    return spans.select(
        "doc_id", *[F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("all")).alias("spans"), "n_added",
    )
