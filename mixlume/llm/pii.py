"""Personal data in text: regular expressions propose spans, checksums confirm them, context words adjust their score. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixlume.llm.common import quoted

# Patterns are possessive where the next part can't match what the part holds, and start at the head of a run or where the last match ended:
# the same leftmost matches in linear time, without recursion on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Code points of context to the left and right of a span.
NEAR = 40
#: kind: pattern, what a text must hold to have a match, check of a match, prior score, context words. The first four kinds are the base ones.
KINDS: dict[str, tuple[str, str, str, float, str]] = {
    "email": (EMAIL, "contains(t, '@')", "true", 0.9, "e-?mails?|contact|write|correo|courriel"),
    "ip": (IP, "contains(t, '.')", f"v rlike '^(?:{_OCTET})(?:[.]{_OCTET}){{3}}$'", 0.6, "ip|hosts?|servers?|address(?:es)?|ping|login|adresse"),
    "card": (CARD, "t rlike '[0-9]'", "luhn", 0.8, "cards?|visa|credit|debit|payments?|amex|karte|carte|tarjeta"),
    "phone": (PHONE, "contains(t, '+')", "length(regexp_replace(v, '[^0-9]', '')) between 9 and 15", 0.6, "phones?|call|tel|mobile|fax|whatsapp|anruf"),
    "iban": (IBAN, "t rlike '[A-Z]{2}[0-9]{2}'", "mod97", 0.9, "iban|accounts?|bank|konto|compte|cuenta|transfers?"),
}
BASE = ("email", "ip", "card", "phone")

_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_CHECKS = {
    # From the right, each second digit counts double, less 9 if over 9.
    "luhn": f"""case when length({_DIGITS}) between 13 and 19 then
        aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + case when i % 2 = 1 then cast(substring({_DIGITS}, -i, 1) as int)
        else cast(substring({_DIGITS}, -i, 1) as int) * 2 - if(cast(substring({_DIGITS}, -i, 1) as int) > 4, 9, 0) end) % 10 = 0 else false end""",
    # The first four characters go to the end; A is 10, Z is 35; the number is 1 modulo 97.
    "mod97": """case when length(replace(v, ' ', '')) between 15 and 34 then
        aggregate(sequence(1, length(replace(v, ' ', ''))), 0, (a, i) -> with_digit(a, substring(concat(substring(replace(v, ' ', ''), 5), left(replace(v, ' ', ''), 4)), i, 1))) = 1 else false end""",
}
_WITH_DIGIT = "(case when ascii({c}) >= 65 then (a * 100 + ascii({c}) - 55) % 97 else (a * 10 + ascii({c}) - 48) % 97 end)"


def _check(kind: str) -> str:
    sql = _CHECKS.get(KINDS[kind][2], KINDS[kind][2])
    if "with_digit" in sql:
        char = sql[sql.index("with_digit(a, ") + len("with_digit(a, ") : sql.rindex(")) = 1")]
        sql = sql.replace(f"with_digit(a, {char})", _WITH_DIGIT.format(c=char))
    return sql


def _before(steps: str, block: int = 256) -> str:
    """SQL: for each element of an array of longs the sum of those before it; in blocks, so that long arrays aren't copied for each element."""
    inner = f"aggregate(slice({steps}, b * {block} + 1, {block}), named_struct('s', 0L, 'a', cast(array() as array<bigint>)), (c, x) -> named_struct('s', c.s + x, 'a', concat(c.a, array(c.s))))"
    blocks = f"transform(sequence(0, (size({steps}) - 1) div {block}), b -> {inner})"
    joined = f"aggregate({blocks}, named_struct('s', 0L, 'a', cast(array() as array<array<bigint>>)), (c, x) -> named_struct('s', c.s + x.s, 'a', concat(c.a, array(transform(x.a, y -> y + c.s)))), c -> flatten(c.a))"
    return f"if(size({steps}) = 0, cast(array() as array<bigint>), {joined})"


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii_spans: an array of struct(kind, start, end, value, score), by kind as in KINDS, then start.

    start and end count code points, end is exclusive. Matches are the leftmost non-overlapping ones of each kind; those that fail their check (octets,
    Luhn, number of digits, mod 97) are dropped without another try. score is the kind's prior, raised by 0.1 with a context word nearby and lowered by 0.1
    without; a context word is a whole word. Null or empty text has no span. Rows stay as they are, repeated ones too; a column named pii_spans is replaced,
    other columns keep their names and values, whatever the names.
    """
    kept = [c for c in docs.columns if c.lower() != "pii_spans"]
    out = docs.select(F.struct(F.lit(0), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)]).alias("_row"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("_pii_t"))
    for kind, (pattern, guard, _, _, _) in KINDS.items():
        has, t = F.expr(guard.replace("(t,", "(_pii_t,").replace("t rlike", "_pii_t rlike")), F.col("_pii_t")
        none = F.array().cast("array<string>")
        out = out.withColumn(f"_pii_m_{kind}", F.when(has, F.regexp_extract_all(t, F.lit(pattern), 0)).otherwise(none))
        out = out.withColumn(f"_pii_p_{kind}", F.when(F.size(f"_pii_m_{kind}") > 0, F.split(t, pattern, -1)).otherwise(none))
    for kind in KINDS:
        m, p = f"_pii_m_{kind}", f"_pii_p_{kind}"
        out = out.withColumn(f"_pii_o_{kind}", F.expr(_before(f"transform({m}, (v, i) -> cast(char_length({p}[i]) + char_length(v) as bigint))")))
    for kind, (_, _, _, prior, words) in KINDS.items():
        m, p, o = f"_pii_m_{kind}", f"_pii_p_{kind}", f"_pii_o_{kind}"
        near = f"(right({p}[i], {NEAR}) rlike '(?i)(?<![a-z])(?:{words})(?![a-z])' or left({p}[i + 1], {NEAR}) rlike '(?i)(?<![a-z])(?:{words})(?![a-z])')"
        span = f"named_struct('kind', '{kind}', 'start', {o}[i] + char_length({p}[i]), 'end', {o}[i] + char_length({p}[i]) + char_length(v), 'value', v, 'score', cast(if({near}, {prior} + 0.1, {prior} - 0.1) as double))"
        ok = f"array_compact(transform({m}, (v, i) -> if({_check(kind)}, {span}, null)))"
        out = out.withColumn(f"_pii_s_{kind}", F.expr(ok))
    return out.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(kept)], F.concat(*[f"_pii_s_{k}" for k in KINDS]).alias("pii_spans"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, a digest of their spans, and all spans."""
    found = find(docs.select("doc_id", "text"))
    spans = F.col("pii_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        count("iban").alias("n_iban"),
        F.size(F.filter(spans, lambda s: s["score"] >= 0.8)).cast("long").alias("n_strong"),
    )
