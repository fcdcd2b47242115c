"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans. Three labelers vote on each, for, against or not at all: a strict form of
its pattern (checksums, number plans, the shape of names), a gazetteer (top-level domains,
networks, issuers, country codes, given names, prefixes of keys) and the words before it.
Expectation-maximisation on the counts of vote patterns estimates how often each labeler votes
so on personal and on other spans, and its posteriors train a logistic span classifier on
votes, kind and length. Counts are over all documents; what reaches the driver is a count for
each of at most 1458 patterns. The base spans are kept whatever the classifier says; it decides
on the others.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import written

#: Base kinds in their order, with patterns written so that each text position is scanned a
#: bounded number of times and no repetition recurses: a match starts at the start of its run
#: (or where the last match ended), and what can't be given back isn't tried again.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further kinds, each proposed by its own pattern.
MORE = {
    "local_phone": r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.?\x20\p{Lu}\p{L}+(?:\x20\p{Lu}\p{L}+)?",
}
MORE["secret"] = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]{0,40}[0-9])[A-Za-z0-9_+/-]{20,}+"
KINDS = [*BASE, *MORE]
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "local_phone": r"[0-9]{3}[-.\x20]", "ssn": r"[0-9]-[0-9]", "iban": r"[A-Z]{2}[0-9]", "person": r"\x20\p{Lu}", "secret": r"[0-9]"}
#: Words that a kind's spans follow.
CUES = {
    "email": "mail|contact|write|reach|schreib|escrib|écri",
    "ip": r"\bip\b|host|server|address|adresse|dirección|from|ping|login",
    "card": "card|visa|master|payment|karte|carte|tarjeta|konto",
    "phone": "call|phone|tel|mobile|fax|ruf|llam|appel",
    "local_phone": "call|phone|tel|mobile|fax|ruf|llam|appel",
    "ssn": "ssn|social|security|tax|number",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "person": r"\b(?:by|from|with|contact|dear|said|asked|von|mit|sagte|par|avec|con|por)\s*$",
    "secret": "token|secret|key|passw|api|bearer|credential|kennwort|contraseña",
}
# The gazetteers' lists.
TLDS = "com org net edu gov mil int info biz io dev app ai at au be br ca ch cn cz de dk es eu fi fr gr hu ie il in it jp kr mx nl no nz pl pt ru se sg tr tw ua uk us za".split()
#: Networks whose addresses name no host of the public network.
NETWORKS = "0. 10. 127. 169.254. 192.168. 192.0.2. 198.18. 198.19. 198.51.100. 203.0.113. 255.".split() + [f"172.{k}." for k in range(16, 32)] + [f"100.{k}." for k in range(64, 128)] + [f"{k}." for k in range(224, 255)]
#: Prefixes and numbers of digits of card issuers.
ISSUERS = {"4": "13|16|19", "5[1-5]": "16", "2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)": "16", "3[47]": "15", "3(?:0[0-5]|[689])": "14", "35": "16", "6(?:011|5|4[4-9])": "16|19"}
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split() + ["21[1-38]", "2[2-6][0-9]", "29[0178]", "35[0-9]", "37[0-8]", "38[0-35-79]", "42[0-13]", "50[0-9]", "59[0-9]", "67[0-9]", "68[0-9]", "85[02356]", "88[0136]", "9[67][0-79]", "99[234568]"]
#: Numbers that were printed so often that they are nobody's.
PRINTED_SSN = ["078-05-1120", "219-09-9999", "457-55-5462", "123-45-6789", "111-11-1111"]
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}
GIVEN_NAMES = "Alice Andrea Andrew Ángel Anna Anne Antonio Barbara Carlos Carmen Charles Christian Claire Daniel David Elena Elizabeth Emily Emma Felix François Frank Georg Hannah Hans Henri James Jan Jean Jennifer Johann John José Juan Julia Julie Karen Karl Klaus Laura Linda Louis Lucas Lucía Luis Manuel Marco María Marie Mark Martin Mary Michael Michel Miguel Nicolas Olivia Patricia Paul Pedro Peter Philippe Pierre Rafael Richard Robert Sabine Sarah Sofía Sophie Stefan Susan Thomas Ursula William Wolfgang".split()
KEY_PREFIXES = ["AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "hf_", "npm_", "pypi-", "SG.", "EAAC", "ya29"]
#: Characters of keys that are written in hexadecimal.
HEX_LENGTHS = [32, 40, 48, 56, 64, 96, 128]
CONTEXT = 40
SPAN = "struct<start:int,end:int,kind:int,base:boolean,v1:int,v2:int,v3:int,size:int>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _base_check(kind: str, m: Column) -> Column:
    """Whether a match of a base kind counts."""
    digits = _digits(m)
    n = F.length(digits)

    def luhn(total: Column, i: Column) -> Column:
        x = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    def octet(p: Column) -> Column:
        p = F.regexp_replace(p, "^0+", "")
        return (F.length(p) <= 3) & (F.coalesce(F.expr("0") + F.when(F.length(p).between(1, 3), p).cast("int"), F.lit(0)) <= 255)

    if kind == "ip":
        return F.forall(F.split(m, "[.]"), octet)
    if kind == "card":
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), luhn) % 10 == 0
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _mod97(m: Column) -> Column:
    """The remainder that a right account number leaves is 1."""
    s = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    digit = lambda i: F.substring(turned, i, F.lit(1))
    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), lambda a, i: (a * F.when(value(digit(i)) < 10, 10).otherwise(100) + value(digit(i))) % 97)


def _like(m: Column, pattern: str) -> Column:
    return F.rlike(m, F.lit(pattern))


def _strict(kind: str, m: Column) -> Column:
    """The first labeler's vote: whether the match has the strict form of its kind."""
    good = {
        "email": lambda: _like(m, r"^[^.][^@]{0,63}@") & ~_like(m, r"\.\.|\.@|@-|-\.|\.-") & _like(m, r"\.[A-Za-z]{2,}$"),
        "ip": lambda: _base_check("ip", m) & ~_like(m, r"(?:^|\.)0[0-9]"),
        "card": lambda: _base_check("card", m) & ~_like(m, r"^([0-9])(?:[\x20-]?\1)+$"),
        "phone": lambda: _base_check("phone", m) & (F.length(F.regexp_replace(m, r"[^(]", "")) == F.length(F.regexp_replace(m, r"[^)]", ""))) & ~_like(m, r"[.-]{2}"),
        "local_phone": lambda: _like(m, r"^\(?[2-9][0-9]{2}\)?[-.\x20]?\x20?[2-9](?!11)[0-9]{2}"),
        "ssn": lambda: ~_like(m, r"^(?:000|666|9)|-00-|0000$"),
        "iban": lambda: _mod97(m) == 1,
        "person": lambda: _like(m, r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$"),
        "secret": lambda: _like(m, r"[0-9].*[0-9].*[0-9]") & _like(m, r"[A-Za-z].*[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= 10),
    }
    return F.when(good[kind](), F.lit(1)).otherwise(F.lit(0))


def _listed(kind: str, m: Column) -> Column:
    """The gazetteer's vote; -1 where its list says nothing of such a match."""
    last, compact = F.lower(F.regexp_extract(m, r"([^.]*)$", 1)), F.regexp_replace(m, " ", "")
    given = F.regexp_extract(m, r"\x20(\p{Lu}\p{L}+)", 1)
    length = F.create_map(*(F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv))
    anyof = lambda xs: "^(?:" + "|".join(xs) + ")"
    dots = [x.replace(".", "[.]") for x in NETWORKS]
    issued = "^(?:" + "|".join(f"{p}[0-9]*:(?:{n})" for p, n in ISSUERS.items()) + ")$"
    says = {
        "email": lambda: F.when(last.isin(TLDS), 1).otherwise(0),
        "ip": lambda: F.when(_like(m, anyof(dots)), 0).otherwise(1),
        "card": lambda: F.when(_like(F.concat_ws(":", _digits(m), F.length(_digits(m)).cast("string")), issued), 1).otherwise(0),
        "phone": lambda: F.when(_like(_digits(m), anyof(COUNTRY_CODES)), 1).otherwise(0),
        "local_phone": lambda: F.when(_like(m, r"^\(?[2-9](?:11|9)"), 0).otherwise(1),
        "ssn": lambda: F.when(m.isin(PRINTED_SSN), 0).otherwise(-1),
        "iban": lambda: F.when(F.length(compact) == F.try_element_at(length, F.substring(m, 1, 2)), 1).otherwise(0),
        "person": lambda: F.when(given.isin(GIVEN_NAMES), 1).otherwise(-1),
        "secret": lambda: F.when(_like(m, anyof(x.replace(".", "[.]") for x in KEY_PREFIXES)) | (_like(m, "^(?:[0-9a-f]+|[0-9A-F]+)$") & F.length(m).isin(HEX_LENGTHS)), 1).otherwise(-1),
    }
    return F.coalesce(says[kind](), F.lit(0))


def _placed(found_name: str, pieces_name: str) -> Column:
    """Matches with their starts: the text was split at the matches, so the lengths of pieces and
    matches add up to them, in code points."""

    def step(a: Column, z: Column) -> Column:
        start = a["at"] + F.length(z[pieces_name])
        m = z[found_name]
        return F.struct((start + F.length(m)).alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), m.alias("m")))).alias("out"))

    both = F.slice(F.arrays_zip(found_name, pieces_name), 1, F.size(found_name))
    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<struct<start:int,m:string>>)").alias("out"))
    return F.aggregate(both, first, step, lambda a: a["out"])


def _spans(kind: str) -> Column:
    found, text = F.col(f"_found_{kind}"), F.col("_text")
    def span(x: Column) -> Column:
        m, start = x["m"], x["start"]
        before = F.lower(F.substring(text, F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT))))
        return F.struct(
            start.alias("start"),
            (start + F.length(m)).alias("end"),
            F.lit(KINDS.index(kind)).alias("kind"),
            (_base_check(kind, m) if kind in BASE else F.lit(False)).alias("base"),
            _strict(kind, m).alias("v1"),
            _listed(kind, m).alias("v2"),
            F.when(F.rlike(before, F.lit(CUES[kind])), F.lit(1)).otherwise(F.lit(-1)).alias("v3"),
            F.least((F.length(m) / 6).cast("int"), F.lit(5)).alias("size"),
        ).cast(SPAN)

    return F.when(F.size(found) > 0, F.transform(_placed(f"_found_{kind}", f"_pieces_{kind}"), span)).otherwise(F.expr(f"cast(array() AS array<{SPAN}>)"))


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the proposed spans of its whole text (null: empty) with their votes: 1 for, 0
    against, -1 none. One pass over the texts; no shuffle."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    none = F.expr("cast(array() AS array<string>)")
    tried = {k: F.rlike("_text", F.lit(_NEEDS[k])) for k in KINDS}
    found = docs.withColumns({f"_found_{k}": F.when(tried[k], F.regexp_extract_all("_text", F.lit(r), F.lit(0))).otherwise(none) for k, r in (BASE | MORE).items()})
    split = found.withColumns({f"_pieces_{k}": F.when(F.size(f"_found_{k}") > 0, F.split("_text", r, -1)).otherwise(none) for k, r in (BASE | MORE).items()})
    return split.select("doc_id", F.concat(*(_spans(k) for k in KINDS)).alias("spans"))


def vote_counts(spans: DataFrame) -> list[tuple[tuple[int, int, int, int, int], int]]:
    """How often each (kind, v1, v2, v3, size) occurs, over all documents: at most
    kinds x 3 x 3 x 3 x 6 rows come to the driver."""
    s = F.explode("spans").alias("s")
    rows = spans.select(s).groupBy("s.kind", "s.v1", "s.v2", "s.v3", "s.size").count().collect()
    return sorted(((r.kind, r.v1, r.v2, r.v3, r["size"]), r["count"]) for r in rows)


VOTES = (-1, 0, 1)
#: Spans seen before any data, by vote: what a labeler says of personal and of other spans.
PRIOR = ({-1: 1.0, 0: 0.5, 1: 2.5}, {-1: 1.0, 0: 2.5, 1: 0.5})


def estimate(counts: list, rounds: int = 200) -> tuple[dict, dict]:
    """Posterior of 'personal' for each vote pattern (kind, v1, v2, v3), and the reliabilities: for
    each kind the share of personal spans and, for each labeler, how often it votes so on
    personal and on other spans (``VOTES`` to a rate). Few prior counts hold a labeler better
    than chance, so that the classes keep their names."""
    by_kind: dict[int, dict] = defaultdict(lambda: defaultdict(int))
    for (kind, v1, v2, v3, _), n in counts:
        by_kind[kind][v1, v2, v3] += n
    posterior, reliability = {}, {}
    for kind, votes in by_kind.items():
        share, total = 0.5, sum(votes.values())
        rates = [tuple({v: w[v] / sum(w.values()) for v in VOTES} for w in PRIOR) for _ in range(3)]
        for _ in range(rounds):
            p = {}
            for vs in votes:
                yes = share * math.prod(r[0][v] for r, v in zip(rates, vs, strict=True))
                no = (1 - share) * math.prod(r[1][v] for r, v in zip(rates, vs, strict=True))
                p[vs] = yes / (yes + no)
            share = (sum(n * p[vs] for vs, n in votes.items()) + 1) / (total + 2)
            for j in range(3):
                seen = tuple(dict(w) for w in PRIOR)
                for vs, n in votes.items():
                    seen[0][vs[j]] += n * p[vs]
                    seen[1][vs[j]] += n * (1 - p[vs])
                rates[j] = tuple({v: w[v] / sum(w.values()) for v in VOTES} for w in seen)
        posterior |= {(kind, *vs): q for vs, q in p.items()}
        reliability[kind] = (share, rates)
    return posterior, reliability


def _inputs(kind: int, v1: int, v2: int, v3: int, size: int) -> list[str]:
    return ["bias", f"kind{kind}", f"v1={v1}", f"v2={v2}", f"v3={v3}", f"kind{kind}v1={v1}", f"size{size}"]


def train_classifier(counts: list, posterior: dict, steps: int = 400, rate: float = 1.0, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic classifier fitted to the posteriors, each pattern by its count."""
    weights: dict[str, float] = defaultdict(float)
    total = sum(n for _, n in counts) or 1
    for _ in range(steps):
        grad: dict[str, float] = defaultdict(float)
        for pattern, n in counts:
            own = _inputs(*pattern)
            p = 1 / (1 + math.exp(-sum(weights[k] for k in own)))
            for k in own:
                grad[k] += n / total * (p - posterior[pattern[:4]])
        for k, g in grad.items():
            weights[k] -= rate * (g + decay * weights[k])
    return dict(weights)


def _accepted(counts: list, weights: dict[str, float], threshold: float) -> list[tuple]:
    return [pattern for pattern, _ in counts if 1 / (1 + math.exp(-sum(weights[k] for k in _inputs(*pattern)))) >= threshold]


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(df: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more: a row for each row.

    Null and empty texts have no spans, very long ones are read whole; other columns aren't read.
    Base spans are those of ``BASE`` that pass their check;
    ``spans`` adds those that the classifier accepts and that overlap no base span; where a
    span of one kind begins with one of another, both stay. Equal texts have equal spans;
    repeated rows stay; an empty table gives an empty one. Without any candidate nothing is trained.
    """
    spans = written(candidates(df, id_col, text_col), "pii-spans")
    counts = vote_counts(spans)
    good = set(_accepted(counts, train_classifier(counts, estimate(counts)[0]), threshold))
    encoded = lambda k, a, b, c, n: (((k * 3 + a + 1) * 3 + b + 1) * 3 + c + 1) * 6 + n
    code = lambda s: encoded(s["kind"], s["v1"], s["v2"], s["v3"], s["size"])
    codes = [encoded(*pattern) for pattern in sorted(good)]
    base = F.filter("spans", lambda s: s["base"])
    more = F.filter("spans", lambda s: ~s["base"] & (code(s).isin(codes) if codes else F.lit(False)))
    split = spans.select("doc_id", base.alias("base"), more.alias("more"))
    clear = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    split = split.withColumn("more", clear)
    return split.select(
        "doc_id",
        *(_count(i).cast("long").alias(f"n_{kind}") for i, kind in enumerate(BASE)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "more")).alias("spans"),
        F.size("more").cast("long").alias("n_more"),
    )
