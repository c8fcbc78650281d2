"""Personal data: patterns propose spans, checks confirm them, context words move the score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order in which spans with one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn", "local_phone")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match can't begin inside a run of digits: the run's start would match too
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
#: Characters of an IBAN by country, as its registry has them.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28,
    HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25,
    QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-]*[0-9])")
_SECRET = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_/+-]{16,})")
_DIGIT = re.compile(r"[0-9]")

#: Score of a confirmed span, words near it that raise the score by RAISE, words that lower it by LOWER. Kinds beyond the
#: base need LEAST: an IBAN or a secret stays unless it is called an example, the last two kinds need a word for them.
RAISE, LOWER, LEAST = 0.2, 0.5, 0.5
_CONTEXT = {
    "email": (0.9, ("mail", "contact", "write", "reply"), ("noreply",)),
    "ip": (0.6, ("ip", "address", "server", "host", "login"), ("version", "release", "section")),
    "card": (0.8, ("card", "visa", "credit", "payment", "debit"), ("order", "isbn", "serial")),
    "phone": (0.7, ("phone", "call", "tel", "fax", "mobile"), ("ratio", "score")),
    "iban": (0.9, ("iban", "account", "bank", "transfer"), ("example", "sample", "specimen", "dummy")),
    "secret": (0.8, ("key", "auth", "login", "access"), ("example", "sample", "placeholder", "dummy")),
    "ssn": (0.4, ("ssn", "social", "security", "taxpayer"), ("order", "part", "invoice", "serial")),
    "local_phone": (0.4, ("phone", "call", "tel", "fax", "mobile", "cell"), ("order", "part", "invoice", "serial")),
}
_NEAR = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: the first four characters go last, letters become 10 to 35, the rest by 97 is 1."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        for d in str(int(c, 36)):
            rest = (rest * 10 + ord(d) - 48) % 97
    return rest == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the run of local characters before it: linear in the text, however long the run."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def ibans(text: str) -> list[tuple[int, int]]:
    """At each possible start as many characters as the country's IBANs have, single spaces between them, if mod-97 confirms them."""
    found, done = [], 0
    for m in _IBAN.finditer(text):
        if m.start() < done or not (n := IBAN_LENGTHS.get(text[m.start() : m.start() + 2])):
            continue
        chars, at = [], m.start()
        while len(chars) < n and at < len(text):
            if text[at] != " ":
                chars.append(text[at])
            elif text[at - 1] == " ":
                break
            at += 1
        iban = "".join(chars)
        if len(iban) == n and iban.isascii() and iban.isalnum() and iban.upper() == iban and not (at < len(text) and text[at].isascii() and text[at].isalnum()) and mod97(iban):
            found.append((m.start(), at))
            done = at
    return found


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end, score) by start, then kind; code points, end exclusive."""
    if not text:
        return []
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found.append(("phone", m.start(), m.end()))
        found += [("iban", a, b) for a, b in ibans(text)]
        found += [(kind, *m.span()) for kind, pattern in (("ssn", _SSN), ("local_phone", _LOCAL_PHONE)) for m in pattern.finditer(text)]
    if "=" in text or ":" in text:
        found += [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    out = []
    for kind, a, b in found:
        score, raise_, lower = _CONTEXT[kind]
        near = set(re.findall("[a-z]+", text[max(0, a - _NEAR) : a].lower() + " " + text[b : b + _NEAR].lower()))
        score += RAISE * bool(near & set(raise_)) - LOWER * bool(near & set(lower))
        out.append((kind, a, b, round(max(0.0, min(1.0, score)), 2)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@F.arrow_udf(SPANS)
def _find(texts: pa.Array) -> pa.Array:
    ends, flat = [0], []
    for t in texts:
        flat += spans_of(t.as_py())
        ends.append(len(flat))
    kind, start, end, score = zip(*flat, strict=True) if flat else ((), (), (), ())
    rows = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(score, pa.float64())], ["kind", "start", "end", "score"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def find_spans(df: DataFrame, text: str = "text", out: str = "pii_spans", least_extra: float = LEAST) -> DataFrame:
    """``df`` with the spans of personal data of each text.

    Base kinds (email, ip, card, phone) stay whatever their score; the others need
    ``least_extra``. Spans of different kinds may overlap. Null and empty texts have no spans, an empty table gives an empty one; rows
    that repeat are each searched; other columns pass unchanged and ``out`` replaces a column of
    that name. Each row is searched alone and whole, so nothing is shuffled.
    """
    keep = lambda s: s["kind"].isin(*KINDS[:4]) | (s["score"] >= least_extra)
    return df.withColumn(out, F.filter(_find(F.col(text)), keep))


def redacted(text: str | None, least_extra: float = LEAST) -> str | None:
    done, parts = 0, []
    for kind, start, end, score in spans_of(text):
        if kind in KINDS[:4] or score >= least_extra:
            if start >= done:
                parts += [text[done:start], f"<{kind.upper()}>"]
            done = max(done, end)
    return "".join([*parts, text[done:]]) if parts else text


def redact(df: DataFrame, text: str = "text", least_extra: float = LEAST) -> DataFrame:
    """``df`` with each span replaced by ``<KIND>``; of spans that overlap the first names the place.

    Null texts stay null, empty ones and texts without spans stay as they are; very long texts are read whole, one at a time. Rows that repeat are
    changed alike; an empty table gives an empty one. Other columns pass, whatever their names.
    """
    run = F.arrow_udf(lambda texts: pa.array([redacted(t.as_py(), least_extra) for t in texts], pa.string()), T.StringType())
    return df.withColumn(text, run(F.col(text)))


def written_out(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(df: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, hash of the base spans, all spans, and the score of each."""
    of = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*KINDS[:4]))
    return find_spans(df.select("doc_id", "text")).select("doc_id", *map(of, KINDS[:4]), F.sha2(written_out(base).cast("binary"), 256).alias("base_sha256"), written_out(F.col("pii_spans")).alias("spans"), F.transform("pii_spans", lambda s: s["score"]).alias("scores"))
