"""Personal data by weak supervision, in DataFrame functions alone.

Base kinds (email, ip, card, phone) are leftmost, non-overlapping matches of their patterns that pass a test; they always
stay. Candidates of further kinds (secret, ssn, tel, person) are matched by wide patterns. Five labelers vote on each: a strict
regex, a gazetteer, words before it that speak for the kind, words before it that speak against personal data, and its shape.
Expectation-maximisation over the counts of vote patterns (a few hundred, however large the corpus) estimates how reliable each
labeler is and how likely each pattern means personal data; a logistic span classifier is then trained on these and adds what
it holds likelier than not.

Matches and the gaps between them come from one pattern, so a match starts where the gaps and matches before it end: a
running sum over a document's own rows, without the text. Null text counts as empty and gives a row with no spans. Repeated
rows come out repeatedly, an empty table gives none. Other columns are ignored by ``spans`` and kept by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "ssn", "tel", "person")
KINDS = BASE + ADDED

# A token of a secret, of any length, begins at the first letter or digit of a run of its signs, or where the match before it ended.
# After more than 255 of + / - each place counts as such a begin: a later start adds no match, as a run of 20 signs matches from its
# first one or lacks digits or letters throughout. Only hexadecimal ones in runs of under 20 may begin later.
SIGN = "[A-Za-z0-9+/_-]"
BEGIN = rf"(?:\G(?<=[A-Za-z0-9])(?={SIGN})|(?=[A-Za-z0-9_])(?:(?<!{SIGN})|(?<=[+/-])(?:(?<=(?<!{SIGN})[+/-]{{1,255}})|(?<=[+/-]{{256}}))))"
MIXED = r"(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])"

# Possessive forms match what the plain ones do and need no stack for long runs. A match begins where a run of its signs does, or
# where the match before it ended: later starts in a run would fail as the first one did, and trying them takes a run's length squared.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?:\bAKIA[0-9A-Z]{{12,24}}|{BEGIN}{MIXED}(?:[0-9a-fA-F]{{16,}}+|{SIGN}{{20,}}+={{0,2}})|\b(?=[0-9a-fA-F]{{16}})(?!{SIGN}{{20}}){MIXED}[0-9a-fA-F]{{16,}}+)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+.(-])(?<!\+[0-9]{1,3}[\x20.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.?\x20\p{Lu}\p{L}+(?:\x20\p{Lu}\p{L}+)?",
}
#: A text without a match of this has no match of the kind's pattern.
MAY = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": r"AKIA|[0-9]", "ssn": r"[0-9]-[0-9]", "tel": r"[0-9]{3}", "person": PATTERNS["person"].split(r"\.?")[0]}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

# Fixed word lists of the labelers.
FOR = {
    "secret": r"(?i)(?:password|passwd|pwd|token|secret|api[ _-]?key|access[ _-]?key|key|credential|bearer)(?:\W{1,3}(?:is|was|ist|es|est))?\W{0,6}$",
    "ssn": r"(?i)(?:ssn|social security|sozialversicherung|seguridad social)\W{0,12}(?:number|no|nr)?(?:\W{1,3}(?:is|was|ist|es|est))?\W{0,4}$",
    "tel": r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono)\w*(?:\W{1,3}(?:is|was|ist|es|est))?\W{0,6}$",
    "person": r"(?i)(?:name|from|by|dear|contact|sincerely|regards|signed|von|par|por)\W{1,3}$",
}
AGAINST = r"(?i)(?:version|license|licence|page|figure|fig|table|chapter|section|isbn|issn|commit|sha1|sha256|md5|checksum|digest|revision|uuid)\W{0,4}$"
#: Given names that are common in the languages of the texts.
GIVEN = (
    "Adam Alice Amy Ana Andrea Andrew Anna Anne Antonio Barbara Ben Bernard Betty Brian Carl Carlos Carmen Carol Catherine Charles Charlotte Chloe Christian Christine Claire Claudia Daniel David Diana Diego "
    "Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Felix Fernando Frank François Frances George Greta Hans Helen Helena Henri Henry Hugo Ines Isabel Jack Jacques James Jan Jane Janet Javier Jean Jennifer "
    "Jessica Joan John Jorge José Joseph Juan Julia Julie Karen Karl Katharina Kevin Klaus Laura Laurent Linda Lisa Louis Louise Lucas Lucía Luis Manuel Marco Margaret Maria María Marie Mark Martin Mary Matthew "
    "Max Michael Michel Miguel Nancy Nicolas Nicole Oliver Olivia Pablo Patricia Patrick Paul Paula Peter Petra Philippe Pierre Rachel Richard Robert Rosa Ruth Sabine Samuel Sandra Sara Sarah Sebastian Sofia Sophie "
    "Stefan Stephen Steven Susan Thomas Ursula Victor Werner William Wolfgang"
).split()
PUBLIC = r"(?i)\x20(?:president|minister|king|queen|pope|saint|watson|strangelove|who|jekyll)\b"


def is_base(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def votes(kind: str, context: Column, m: Column) -> list[Column]:
    """1 for, -1 against, 0 no vote: strict regex, gazetteer, words for, words against, shape."""
    vote = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)
    if kind == "secret":
        strict = vote(m.rlike(r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-.+|sk-.+)$"))
        gazetteer = vote(m.rlike("^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|sk_|pk_|rk_|xox|AIza|ya29|eyJ|npm_|pypi-|SG)"), m.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-"))
        shape = vote(m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.length(m) >= 16), ~m.rlike("[0-9]") | ~m.rlike("[A-Za-z]") | m.rlike("^[A-Za-z]+(?:[/_-][A-Za-z0-9]+)+$"))
    elif kind == "ssn":
        strict = vote(~m.rlike("^(?:000|666|9)|-00-|-0000$"), m.rlike("^(?:000|666|9)|-00-|-0000$"))
        gazetteer = vote(F.lit(False), m.isin("123-45-6789", "078-05-1120"))
        shape = vote(F.lit(False), m.rlike(r"^([0-9])\1{2}-\1{2}-\1{4}$"))
    elif kind == "tel":
        strict = vote(m.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}$"), m.rlike(r"^\(?[01]"))
        gazetteer = vote(m.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-]555"), m.rlike(r"^\(?(?:[0-9])11\)?"))
        shape = vote(m.rlike(r"^\([0-9]{3}\)|-.*-"), m.rlike(r"^[0-9]{3}\x20[0-9]{3}\x20"))
    else:
        strict = vote(m.rlike(r"^\p{L}+\.?\x20\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)?$"), m.rlike(r"\x20\p{Lu}{2,}"))
        gazetteer = vote(F.split(m, " ")[1].isin(GIVEN) & (F.size(F.split(m, " ")) > 2), m.rlike(PUBLIC))
        shape = vote(m.rlike(r"\x20\S+\x20"))
    return [strict, gazetteer, vote(context.rlike(FOR[kind])), vote(F.lit(False), context.rlike(AGAINST)), shape]


def _split(kind: str, text: Column) -> Column:
    """array<(gap, m)>: each match with the text before it; the last entry is the rest, with no match."""
    pattern = F.lit(PATTERNS[kind])
    pieces = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"))
    return F.when(text.rlike(MAY[kind]), pieces)


CONTEXT = 40


def _piece(k: int):
    return lambda x: F.struct(F.lit(k).alias("kind"), F.length(x["gap"]).alias("gap"), F.right(x["gap"], F.lit(CONTEXT)).alias("context"), x["m"].alias("m"))


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id and per match kind (number), start, end, context, m; a document without matches has one row of nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for k, kind in enumerate(KINDS):
        piece = _piece(k)
        found.append(F.coalesce(F.transform(_split(kind, text), piece), F.array().cast("array<struct<kind:int,gap:int,context:string,m:string>>")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.filter(F.concat(*found), lambda x: x["m"].isNotNull()).alias("all"))
    rows = rows.select("row", "doc_id", F.posexplode_outer("all").alias("pos", "x")).select("row", "doc_id", "pos", "x.*")
    before = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(before))
    return rows.select("row", "doc_id", "kind", (F.col("end") - F.length("m")).alias("start"), "end", "context", "m")


def features(kind: Column, context: Column, m: Column) -> list[Column]:
    """The five votes and a class of length, by the number of the kind."""
    every = [votes(k, context, m) for k in ADDED]
    out = []
    for j in range(5):
        c = F.lit(0)
        for k, v in zip(ADDED, every, strict=True):
            c = F.when(kind == KINDS.index(k), v[j]).otherwise(c)
        out.append(c.alias(f"v{j}"))
    return [*out, size_class(m).alias("size")]


def size_class(m: Column) -> Column:
    return F.when(F.length(m) < 14, 0).when(F.length(m) < 24, 1).otherwise(2)


NAMES = ["v0", "v1", "v2", "v3", "v4", "size"]


def expectation_maximisation(patterns: dict[tuple, int], rounds: int = 50) -> tuple[dict[tuple, float], dict]:
    """Posterior of each (kind, votes) pattern, and by kind each labeler's chances of -1, 0, 1 given no and given yes.

    Labelers are independent given the truth. They start out as better than chance, and counts are smoothed.
    """
    start = ([0.35, 0.45, 0.2], [0.1, 0.4, 0.5])
    kinds = {p[0] for p in patterns}
    table = {k: [[list(start[0]), list(start[1])] for _ in range(5)] for k in kinds}
    prior = dict.fromkeys(kinds, 0.5)
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for p in patterns:
            yes, no = math.log(prior[p[0]]), math.log(1 - prior[p[0]])
            for own, v in zip(table[p[0]], p[1:], strict=True):
                no, yes = no + math.log(own[0][v + 1]), yes + math.log(own[1][v + 1])
            posterior[p] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
        for k in kinds:
            got = [(p[1:], c, posterior[p]) for p, c in patterns.items() if p[0] == k]
            for j in range(5):
                for t in (0, 1):
                    n = [20 * x for x in start[t]]
                    for v, c, q in got:
                        n[v[j] + 1] += c * (q if t else 1 - q)
                    table[k][j][t] = [x / sum(n) for x in n]
            prior[k] = (1 + sum(c * q for _, c, q in got)) / (2 + sum(c for _, c, _ in got))
    return posterior, table


class Classifier:
    """Logistic regression over kind, votes and length class; trained on counted patterns with soft labels."""

    def __init__(self, counted: dict[tuple, int], rounds: int = 300):
        patterns: dict[tuple, int] = {}
        for p, c in counted.items():
            patterns[p[:6]] = patterns.get(p[:6], 0) + c
        posterior, self.reliability = expectation_maximisation(patterns) if patterns else ({}, {})
        self.weights = {("bias",): 0.0}
        rows = [(self.active(p), math.log1p(c), posterior[p[:6]]) for p, c in sorted(counted.items())]
        total = sum(c for _, c, _ in rows) or 1
        for _ in range(rounds):
            step: dict[tuple, float] = {}
            for names, c, y in rows:
                q = 1 / (1 + math.exp(-sum(self.weights.get(n, 0.0) for n in names)))
                for n in names:
                    step[n] = step.get(n, 0.0) + c * (y - q)
            for n, g in step.items():
                self.weights[n] = self.weights.get(n, 0.0) * 0.999 + 4.0 * g / total

    @staticmethod
    def active(p: tuple) -> list[tuple]:
        return [("bias",), ("kind", p[0]), *((f"v{j}", v) for j, v in enumerate(p[1:6]) if v), *((f"v{j}", v, p[0]) for j, v in enumerate(p[1:6]) if v), ("size", p[6])]

    def likely(self, kind: Column, values: list[Column]) -> Column:
        """True where the classifier holds a span of the kind and feature values likelier personal data than not."""
        score = F.lit(self.weights[("bias",)])
        columns = {"kind": kind} | dict(zip(NAMES, values, strict=True))
        for (name, *value), w in sorted(self.weights.items(), key=str):
            if value:
                here = columns[name] == value[0]
                score = score + F.when(here & (kind == value[1]) if len(value) > 1 else here, w).otherwise(0.0)
        return score > 0


def train(found: DataFrame) -> Classifier:
    """From the table of candidates; a few hundred rows of counts come to the driver."""
    rows = found.where(F.col("kind") >= len(BASE)).select("kind", *features(F.col("kind"), F.col("context"), F.col("m")))
    return Classifier({tuple(r)[:-1]: r["count"] for r in rows.groupBy("kind", *NAMES).count().collect()})


def decided(found: DataFrame, model: Classifier) -> DataFrame:
    """The candidates with keep: base ones that pass their test, others by the classifier."""
    keep = F.lit(None).cast("boolean")
    for k, kind in enumerate(BASE):
        keep = F.when(F.col("kind") == k, is_base(kind, F.col("m"))).otherwise(keep)
    values = [F.col(n) for n in NAMES]
    rows = found.select("*", *features(F.col("kind"), F.col("context"), F.col("m")))
    return rows.withColumn("keep", F.when(F.col("kind") >= len(BASE), model.likely(F.col("kind"), values)).otherwise(keep)).drop(*NAMES)


def spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; positions in code points."""
    found = materialize(candidates(docs), "pii-candidates")
    rows = decided(found, train(found))
    span = F.when(F.col("keep"), F.struct("start", "kind", "end"))
    out = rows.groupBy("row", "doc_id").agg(*(F.count_if(F.col("keep") & (F.col("kind") == k)).alias(f"n_{n}") for k, n in enumerate(BASE)), F.array_sort(F.collect_list(span)).alias("all"))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, text), ",")
    base = F.filter("all", lambda x: x["kind"] < len(BASE))
    return out.select("doc_id", *(f"n_{n}" for n in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def _redacted(kind: str, model: Classifier):
    """The step that marks one kind; it is a lambda's body, which binds the text so far, so that steps do not multiply."""

    def put(x):
        m, context = x["m"], F.right(x["gap"], F.lit(CONTEXT))
        good = is_base(kind, m) if kind in BASE else model.likely(F.lit(KINDS.index(kind)), [*votes(kind, context, m), size_class(m)])
        return F.concat(x["gap"], F.when(m.isNull(), "").when(good, f"[{kind.upper()}]").otherwise(m))

    return lambda t: F.coalesce(F.array_join(F.transform(_split(kind, t), put), ""), t)


def redact(docs: DataFrame) -> DataFrame:
    """The documents (all columns) with [KIND] in place of each span found; null texts stay null.

    Kinds are replaced one after the other, so of overlapping spans the kind listed first gives the mark.
    """
    model = train(materialize(candidates(docs.select("doc_id", "text")).where(F.col("kind") >= len(BASE)), "pii-candidates"))
    text = F.col("text")
    for kind in KINDS:
        text = F.get(F.transform(F.array(text), _redacted(kind, model)), F.lit(0))
    return docs.withColumn("text", text)
