"""Personal data: pattern matches, and more spans by weak supervision. Built-ins only.

Four kinds of spans are defined by their patterns and always stay. Other patterns only
propose spans. Labelers vote on every span, proposed or not: its format, a checksum or
range, a gazetteer, cue words before it, and how varied its characters are. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is, and
a logistic regression on the votes, trained on the resulting posteriors, is the span
classifier. Votes are counted over all spans of all documents; there are at most
``len(KINDS) * 3**5`` patterns, which is all that reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from plumbline.session import keep

# A run is entered at its beginning, or where the last match ended (\G), and quantifiers
# are possessive where giving back can't help: the same matches, in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = (
    r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)"
    r"[\x20]?[=:][\x20]?[\"']?[A-Za-z0-9+/_-]{12,}+"
)
LOCAL = r"(?<![0-9+(.-])(?<!\+[0-9]{1,3}[\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

BASE = ("email", "ip", "card", "phone")
#: In the order of output; the first four are the base kinds.
KINDS = {
    "email": EMAIL,
    "ip": IP,
    "card": CARD,
    "phone": PHONE,
    "secret": SECRET,
    "local": LOCAL,
    "social": SOCIAL,
    "iban": IBAN,
}
OCTETS = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}"
#: Gazetteers, fixed values. Country domains by first letter and further letters.
COUNTRY_DOMAINS = (
    "a[cdefgilmoqrstuwxz] b[abdefghijmnorstvwyz] c[acdfghiklmnoruvwxyz] d[ejkmoz] e[ceghrstu] "
    "f[ijkmor] g[abdefghilmnpqrstuwy] h[kmnrtu] i[delmnoqrst] j[emop] k[eghimnprwyz] "
    "l[abcikrstuvy] m[acdeghklmnopqrstuvwxyz] n[acefgilopruz] om p[aefghklmnrstwy] qa r[eosuw] "
    "s[abcdeghijklmnorstuvxyz] t[cdfghjklmnortvwz] u[agksyz] v[aceginu] w[fs] y[et] z[amw]"
)
COMMON_DOMAINS = (
    "com org net edu gov int mil info biz name pro mobi jobs travel museum coop aero asia cat tel "
    "app blog cloud dev email online shop site store tech xyz"
)
#: Addresses of no machine of a person: loopback, link-local, for documents, broadcast.
IDLE_ADDRESSES = r"0\.|127\.|169\.254\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.|255\."
#: First digits of card numbers by issuer.
CARD_ISSUERS = r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[0-9]|6011|6[24-9]|50|5[6-9]"
#: Country calling codes.
CALLING_CODES = r"1|7|2(?:0|7|[1-69][0-9])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[0-9])|5(?:[1-8]|[09][0-9])|6(?:[0-6]|[7-9][0-9])|8(?:[1246]|[058][0-9])|9(?:[0-58]|[679][0-9])"
#: Lengths of account numbers by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 "
    "EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 "
    "IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 "
    "NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 "
    "TR26 UA29 VA22 VG24 XK20"
)
CUES = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|address|client",
    "card": "card|visa|credit|debit|payment",
    "phone": "call|tel|phone|mobile|fax",
    "secret": "login|user|auth|config|env",
    "local": "call|tel|phone|mobile|fax",
    "social": "ssn|social|security|tax",
    "iban": "iban|account|bank|transfer",
}
CONTEXT_CHARS = 24
EM_ROUNDS, FIT_ROUNDS, FIT_STEP = 50, 400, 0.5


def digits(x: F.Column) -> F.Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: F.Column) -> F.Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.split(F.reverse(number), "")

    def value(d: F.Column, i: F.Column) -> F.Column:
        doubled = d.cast("int") * (1 + i % 2)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    return F.aggregate(F.transform(back, value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, match: F.Column) -> F.Column:
    """What a match must satisfy beyond its pattern."""
    n = F.length(digits(match))
    if kind == "ip":
        return match.rlike(f"^{OCTETS}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def spans_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, spans): all spans of a document, by kind as listed, then by start."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    # matches first, each pattern run once over a text; gaps only where something matched
    rows = rows.select(
        "doc_id",
        "text",
        *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in KINDS.items()],
    )
    # each step a projection of its own, so that blocks read finished arrays
    rows = rows.select("doc_id", *[_pairs(k).alias(f"p_{k}") for k in KINDS])
    rows = rows.select("doc_id", *[_blocks(k).alias(f"b_{k}") for k in KINDS])
    return rows.select("doc_id", F.concat(*[_placed(k) for k in KINDS]).alias("spans"))


PAIR = "struct<gap:string,match:string>"
SPAN = "struct<kind:string,start:int,end:int,match:string,before:string>"


def _pairs(kind: str) -> F.Column:
    """The matches, each with the text between it and the one before it."""
    matches = F.col(f"m_{kind}")
    gaps = F.slice(F.split("text", KINDS[kind], -1), F.lit(1), F.size(matches))
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.when(F.size(matches) > 0, pairs).otherwise(F.array().cast(f"array<{PAIR}>"))


def _blocks(kind: str) -> F.Column:
    """The matches in blocks of about the root of their number, placed from a block's start.

    Only the array of one block grows match by match: n matches cost n**1.5 at most.
    """
    pairs = F.col(f"p_{kind}")

    def step(state: F.Column, x: F.Column) -> F.Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            end.alias("end"),
            x["match"].alias("match"),
            F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("before"),
        )
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    width = F.ceil(F.sqrt(F.size(pairs))).cast("int")
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    blocks = F.transform(
        F.sequence(F.lit(1), F.size(pairs), F.greatest(width, F.lit(1))),
        lambda first: F.aggregate(F.slice(pairs, first, width), start, step),
    )
    none = F.array().cast(f"array<struct<at:int,spans:array<{SPAN}>>>")
    return F.when(F.size(pairs) > 0, blocks).otherwise(none)


def _placed(kind: str) -> F.Column:
    """The valid matches of all blocks, placed from the beginning of the text."""
    blocks = F.col(f"b_{kind}")

    def step(state: F.Column, block: F.Column) -> F.Column:
        at = state["at"] + block["at"]
        return F.struct(at.alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(blocks, none, step, lambda s: s["starts"])

    def moved(block: F.Column, by: F.Column) -> F.Column:
        kept = F.filter(block["spans"], lambda s: valid(kind, s["match"]))
        return F.transform(
            kept, lambda s: s.withField("start", s["start"] + by).withField("end", s["end"] + by)
        )

    return F.flatten(F.zip_with(blocks, starts, moved))


# ---- labelers: 1 for, -1 against, 0 no opinion ---------------------------------------


def _vote(yes: F.Column, no: F.Column) -> F.Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(span: F.Column) -> F.Column:
    """The five votes on a span as a struct."""
    kind, match = span["kind"], span["match"]
    number = digits(match)
    before = F.lower(span["before"])
    domain = F.element_at(F.split(match, r"\."), -1)
    known_domain = f"^(?:{'|'.join(f'{COMMON_DOMAINS} {COUNTRY_DOMAINS}'.split())})$"
    plain = F.regexp_replace(match, " ", "")
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = cue | ((kind == k) & before.rlike(f"(?<![a-z])(?:{words})[a-z]{{0,3}}[^a-z0-9]{{0,4}}$"))
    numeric = kind.isin("ip", "card", "phone", "local", "social")
    varied = F.size(F.array_distinct(F.split(match, "")))
    strict = {
        "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,10}$",
        "ip": r"^(?:[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
        "card": r"^[3-6][0-9]{15,18}$|^[3-6][0-9]{3}(?:[ -][0-9]{4}){3}$",
        "phone": r"^\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{2,4}\)?[0-9 .-]{5,12}$",
        "secret": r"(?i)[=:] ?[\"']?(?=[a-z0-9+/_-]*[0-9])(?=[a-z0-9+/_-]*[a-z])[a-z0-9+/_-]+$",
        "local": r"^\(?[2-9][0-9]{2}\)?[ .-]{1,2}[2-9][0-9]{2}[.-][0-9]{4}$",
        "social": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
        "iban": r"^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$",
    }
    shaped = F.lit(False)
    for k, p in strict.items():
        shaped = shaped | ((kind == k) & match.rlike(p))
    return F.struct(
        _vote(shaped, ~shaped).alias("format"),
        F.when(kind == "card", _vote(luhn(number), F.lit(True)))
        .when(kind == "ip", _vote(match.rlike(f"^{OCTETS}$"), F.lit(True)))
        .when(kind.isin("phone", "local"), _vote(F.length(number).between(10, 15), F.lit(False)))
        .otherwise(0)
        .alias("check"),
        F.when(kind == "email", _vote(F.lower(domain).rlike(known_domain), F.lit(True)))
        .when(kind == "ip", _vote(F.lit(False), match.rlike(f"^(?:{IDLE_ADDRESSES})")))
        .when(kind == "card", _vote(number.rlike(f"^(?:{CARD_ISSUERS})"), F.lit(True)))
        .when(kind == "phone", _vote(number.rlike(f"^(?:{CALLING_CODES})"), F.lit(True)))
        .when(kind == "local", _vote(number.rlike("^[2-9][0-8][0-9][2-9]"), F.lit(True)))
        .when(kind == "iban", _vote(F.concat(F.left(match, F.lit(2)), F.length(plain).cast("string")).isin(IBAN_LENGTHS.split()), F.lit(True)))
        .otherwise(0)
        .alias("gazetteer"),
        _vote(cue, before.rlike(r"(?:version|release|isbn|order|invoice|page|section|no\.?|#)[^a-z0-9]{0,3}$")).alias("context"),
        F.when(numeric, _vote(F.size(F.array_distinct(F.split(number, ""))) >= 4, varied <= 3))
        .otherwise(_vote(varied >= 8, varied <= 4))
        .alias("variety"),
    )


LABELERS = ("format", "check", "gazetteer", "context", "variety")


def reliabilities(counts: list[Row]) -> dict[tuple, float]:
    """Posterior that a span is personal data, for each (kind, votes), by EM.

    The share of true spans is a kind's own; a labeler's chances of voting for or against,
    given the truth, are shared by all kinds. No opinion says nothing: many labelers have
    none on some kinds. Starts from the majority.
    """
    patterns = [(r["kind"], tuple(r[x] for x in LABELERS), r["n"]) for r in counts]
    post = {
        (k, v): 1 / (1 + math.exp(-1.5 * sum(v))) for k, v, _ in patterns
    }
    for _ in range(EM_ROUNDS):
        share, size = {}, {}
        chance = [[{-1: 1.0, 1: 1.0} for _ in range(2)] for _ in LABELERS]
        for k, v, n in patterns:
            p = post[k, v]
            share[k] = share.get(k, 1.0) + n * p
            size[k] = size.get(k, 2.0) + n
            for j, x in enumerate(v):
                if x:
                    chance[j][1][x] += n * p
                    chance[j][0][x] += n * (1 - p)
        for k, v, _ in patterns:
            odds = math.log(share[k] / (size[k] - share[k]))
            for j, x in enumerate(v):
                if x:
                    true, false = chance[j][1], chance[j][0]
                    odds += math.log(true[x] / sum(true.values())) - math.log(false[x] / sum(false.values()))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def classifier(counts: list[Row], post: dict[tuple, float]) -> dict[str, float]:
    """Weights of a logistic regression on kinds and votes, fitted to the posteriors."""
    total = sum(r["n"] for r in counts)
    weights = {f"kind {k}": 0.0 for k in KINDS} | {f"{j} {x}": 0.0 for j in LABELERS for x in (-1, 1)}
    rows = []
    for r in counts:
        v = tuple(r[x] for x in LABELERS)
        on = [f"kind {r['kind']}"] + [f"{j} {x}" for j, x in zip(LABELERS, v, strict=True) if x]
        # the root keeps rare kinds in the fit beside frequent ones
        rows.append((on, post[r["kind"], v], math.sqrt(r["n"] / total)))
    scale = sum(w for _, _, w in rows) or 1.0
    for _ in range(FIT_ROUNDS):
        slope = {k: 1e-3 * w for k, w in weights.items()}
        for on, p, w in rows:
            guess = 1 / (1 + math.exp(-sum(weights[k] for k in on)))
            for k in on:
                slope[k] += w / scale * (guess - p)
        weights = {k: w - FIT_STEP * 4 * slope[k] for k, w in weights.items()}
    return weights


def _score(span: F.Column, weights: dict[str, float]) -> F.Column:
    total = F.lit(0.0)
    for k in KINDS:
        total = total + F.when(span["kind"] == k, weights[f"kind {k}"]).otherwise(0.0)
    vote = votes(span)
    for j in LABELERS:
        total = total + F.when(vote[j] == 1, weights[f"{j} 1"]).when(vote[j] == -1, weights[f"{j} -1"]).otherwise(0.0)
    return total


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and spans (kind, start, end, match).

    Base spans always stay, proposed ones where the classifier gives them at least one
    half. A null text is empty. Spans are in code points, end exclusive, ordered by kind
    as in KINDS, then by start; those of one kind don't overlap, those of different kinds
    may. Equal rows are answered alike, an empty table gives an empty one, and very long
    texts are read whole. Other columns are not looked at.
    """
    rows = keep(spans_of(docs, id_col, text_col))
    each = rows.select(F.explode("spans").alias("s")).select("s.kind", votes(F.col("s")).alias("v"))
    counts = each.groupBy("kind", *[F.col(f"v.{x}").alias(x) for x in LABELERS]).agg(
        F.count("*").alias("n")
    )
    counted = counts.orderBy("kind", *LABELERS).collect()
    weights = classifier(counted, reliabilities(counted))
    stays = F.filter(
        "spans", lambda s: s["kind"].isin(*BASE) | (_score(s, weights) >= 0)
    )
    return rows.select("doc_id", F.transform(stays, lambda s: s.dropFields("before")).alias("spans"))


def _is(kind: str):
    return lambda x: (x == kind).cast("int")


def digest(found_spans: DataFrame) -> DataFrame:
    """Counts of base kinds, a hash of the base spans, and all spans as text."""

    def written(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        F.size(F.array_remove(F.transform(kinds, _is(k)), 0)).cast("long").alias(f"n_{k}") for k in BASE
    ]
    return found_spans.select(
        "doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )
