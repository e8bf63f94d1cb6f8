"""Text evidence as Column expressions: content tokens, strong tokens, amounts, subjects, references, trailers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words, and below the scoring constants and evidence patterns, decide results and must be these.
STOPWORDS = sorted(
    set(
        "a an the and or but if then else for of to in on at by with from as is are was were be been being do does did done "
        "have has had having it its this that these those i you he she they we not no yes so than too very can will just "
        "about into over under again further once here there when where why how all any both each few more most other some "
        "such only own same s t don now re fwd fw reply forward".split()
    )
)
MIN_PREFIX, PREFIX_DISCOUNT, SATURATION = 4, 0.6, 1.5

EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
DATE = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b"
IDENT = r"(?i)\b[a-z]{2,}[-_/]?\d{2,}(?:[-_/]\w+)*\b"
MONEY = r"(?<![\w.])\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|(?<![\w.])\d+\.\d{2}(?![\w.])"
NUMBER = r"(?<![\w.])\d{3,}(?![\w.])"


def _stop() -> Column:
    return F.array(*map(F.lit, STOPWORDS))


def content_tokens(text: Column) -> Column:
    """Distinct lower-cased words of two letters and more that are no stop words, in order of first occurrence."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z']+"), F.lit(0))
    return F.array_except(F.array_distinct(found), _stop())


def amount(token: Column) -> Column:
    """4,250.00, 4250.00 and 4250 are one token."""
    plain = F.regexp_replace(token, ",", "")
    fixed = F.format_string("%.2f", plain.cast("double"))
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")


def strong_tokens(text: Column) -> Column:
    """E-mail addresses, dates, identifiers, amounts and numbers. Each kind's spans are blanked before the next kind
    looks, so that a part of a stronger token is never one of its own; bare years are none."""
    left, parts = F.coalesce(text, F.lit("")), []
    for kind, pattern in (("email", EMAIL), ("date", DATE), ("ident", IDENT), ("money", MONEY), ("number", NUMBER)):
        found = F.regexp_extract_all(left, F.lit(pattern), F.lit(0))
        if kind in ("money", "number"):
            found = F.transform(found, amount)
        else:
            found = F.transform(found, lambda x: F.trim(F.lower(x)))
        if kind == "number":
            found = F.filter(found, lambda x: ~x.rlike(r"^(19|20)\d{2}$"))
        parts.append(found)
        left = F.regexp_replace(left, pattern, " ")
    return F.array_distinct(F.concat(*parts))


def pooled_text(*attrs: Column) -> Column:
    """Distinct non-blank values in order, joined by a space."""
    values = F.filter(F.array(*attrs), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.array_join(F.transform(F.array_distinct(values), lambda x: F.trim(x)), " ")


def subject_key(subject: Column) -> Column:
    """A mail subject without reply and forward marks, white space collapsed, lower-cased."""
    bare = F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^\s*((re|fwd?|aw|sv)(\[\d+\])?\s*:\s*)+", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def references(text: Column) -> Column:
    """Array of (kind, number, tier): merged pull requests, squashed ones, closing words and bare mentions, the strongest
    mention of each (kind, number) once."""
    t = F.coalesce(text, F.lit(""))

    def found(kind: str, pattern: str, tier: int) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(-tier).alias("order"), F.lit(kind).alias("kind"), n.cast("bigint").alias("number"), F.lit(tier).alias("tier")))

    every = F.concat(
        found("pr", r"(?i)Merge pull request #(\d+)", 4),
        found("pr", r"\(#(\d+)\)", 3),
        found("issue", r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s*:?\s+#(\d+)", 3),
        found("issue", r"(?<![\w(#])#(\d+)\b", 2),
    )
    ordered = F.array_sort(every)
    # the first mention of a number in order of strength stands; a later one of the same kind is dropped
    keep = F.filter(ordered, lambda x, i: ~F.exists(F.slice(ordered, F.lit(1), i), lambda y: (y["kind"] == x["kind"]) & (y["number"] == x["number"])))
    return F.transform(keep, lambda x: F.struct(x["kind"].alias("kind"), x["number"].alias("number"), x["tier"].alias("tier")))


def merged_branch(subject: Column) -> Column:
    """The branch named by a merge commit's subject, else null."""
    b = F.regexp_extract(F.coalesce(subject, F.lit("")), r"(?i)Merge (?:branch '([^']+)'|pull request #\d+ from (\S+))", 1)
    p = F.regexp_extract(F.coalesce(subject, F.lit("")), r"(?i)Merge pull request #\d+ from (\S+)", 1)
    return F.nullif(F.when(b != "", b).otherwise(p), F.lit(""))


def co_authors(body: Column) -> Column:
    """Array of (name, email) of Co-authored-by trailers."""
    pattern = r"(?im)^\s*co-authored-by:\s*(.*?)\s*<([^>]+)>\s*$"
    b = F.coalesce(body, F.lit(""))
    return F.transform(F.arrays_zip(F.regexp_extract_all(b, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(b, F.lit(pattern), F.lit(2)).alias("email")), lambda x: F.struct(x["name"].alias("name"), F.lower(x["email"]).alias("email")))


def address(value: Column) -> Column:
    """The first mail address in a header, lower-cased, else null."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(value, F.lit("")), r"[\w.+'-]+@[\w.-]+\w", 0)), F.lit(""))


def addresses(value: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"[\w.+'-]+@[\w.-]+\w"), F.lit(0)), F.lower))


def message_id(value: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(value, F.lit("")), r"<([^>\s]+)>", 1), F.lit(""))


def person_id(email: Column, name: Column) -> Column:
    """person:address where there is one, else person:name, else null."""
    e, n = F.lower(F.trim(F.coalesce(email, F.lit("")))), F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(e != "", F.concat(F.lit("person:"), e)).when(n != "", F.concat(F.lit("person:"), n))


def humanize(action: Column) -> Column:
    words = F.regexp_replace(F.coalesce(action, F.lit("")), r"[_-]+", " ")
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 1_000_000))


def plural(noun: Column) -> Column:
    """The regular English plural."""
    return F.when(noun.rlike("[^aeiou]y$"), F.regexp_replace(noun, "y$", "ies")).when(noun.rlike("(s|x|z|ch|sh)$"), F.concat(noun, F.lit("es"))).otherwise(F.concat(noun, F.lit("s")))


def claim_id(*parts: Column) -> Column:
    """c- and 12 hexadecimal digits of the SHA-1 of the trimmed, lower-cased parts."""
    body = F.concat_ws("\x1f", *[F.lower(F.trim(p.cast("string"))) for p in parts])
    return F.concat(F.lit("c-"), F.left(F.sha1(body.cast("binary")), F.lit(12)))


def fallback_id(*parts: Column) -> Column:
    return F.left(F.sha1(F.concat_ws("\n", *parts).cast("binary")), F.lit(16))


def is_bot(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike(r"\[bot\]|(^|\W)bot(\W|$)|no-?reply|do-?not-?reply|automat|notification|mailer-daemon|^system$"), F.lit(False))
