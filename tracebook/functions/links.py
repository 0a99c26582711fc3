"""Addresses, revisions and question numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Second-level names under which registrable domains have three parts, and suffixes of primary sources.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
PRIMARY = ".gov .edu .gov.cn .edu.cn .gov.uk .ac.uk .gov.tw .edu.tw .gov.hk .edu.hk .edu.au .gov.au".split()
#: Publishers and bodies of standards that count as primary too, with what lies under them.
PRIMARY_HOSTS = "cabr-fire.com kepuchina.cn samr.gov.cn cmpedu.com heep.cn nist.gov nfpa.org iso.org springer.com sciencedirect.com iafss.org".split()


def is_web_address(value: Column) -> Column:
    """http or https with a host; no user part, blanks or control characters."""
    return F.coalesce(value.rlike(r"(?i)^https?://[^/?#@\s\x00-\x1f]+(?:[/?#][^\s\x00-\x1f]*)?$"), F.lit(False))


def web_origin(value: Column) -> Column:
    """The registrable domain of an address, in lower case; null for others."""
    host = F.regexp_replace(F.lower(F.regexp_extract(value, r"(?i)^https?://([^/?#:\s]+)", 1)), r"^www\.", "")
    parts = F.split(host, r"\.")
    last = F.when((F.size(parts) > 2) & F.element_at(parts, -2).isin(SECOND_LEVEL), 3).otherwise(2)
    return F.when(is_web_address(value) & (F.size(parts) >= 2), F.array_join(F.slice(parts, F.greatest(F.size(parts) - last + 1, F.lit(1)), last), ".")).when(is_web_address(value), host)


def is_primary(value: Column) -> Column:
    """Whether an address belongs to a public or scholarly institution."""
    host = F.lower(F.regexp_extract(value, r"(?i)^https?://([^/?#:\s]+)", 1))
    found = F.lit(False)
    for s in PRIMARY:
        found = found | F.endswith(host, F.lit(s))
    for h in PRIMARY_HOSTS:
        found = found | (host == h) | F.endswith(host, F.lit("." + h))
    return F.coalesce(found, F.lit(False))


def revision(*columns: Column) -> Column:
    """A hash of the columns in their order; nulls count and differ from empty."""
    return F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)


def statements(definition: Column, numbers: Column, note: Column) -> Column:
    """What a claim states, one by one: struct(id, kind, text) of its
    definition, each number, and its note if it has one."""
    make = lambda i, k, t: F.struct(i.alias("id"), F.lit(k).alias("kind"), t.alias("text"))
    first = F.array(make(F.lit("definition"), "definition", F.coalesce(definition, F.lit(""))))
    each = F.transform(F.coalesce(numbers, F.array().cast("array<string>")), lambda x, i: make(F.concat(F.lit("number-"), (i + 1).cast("string")), "number", x))
    last = F.when(F.coalesce(F.trim(note), F.lit("")) != "", F.array(make(F.lit("note"), "note", note))).otherwise(F.slice(first, 1, 0))
    return F.concat(first, each, last)


#: A question begins a line, with a number and a mark.
QUESTION = r"(?m)^\s*(?:第\s*(\d{1,3})\s*题\s*[:：、.]?|(?:[（(]\s*)?(\d{1,3})\s*[.．、:：)）](?!\d))"
CHOICE = r"(?<![A-Za-z])([ABCD])[.．、:：)）\s\d\x{4E00}-\x{9FFF}]"


def question_numbers(text: Column) -> Column:
    """The numbers of the questions of a text, each once; only if there are two or more."""
    number = lambda m: F.regexp_extract(m, r"\d{1,3}", 0).cast("int")
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(QUESTION), F.lit(0)), number))
    return F.when(F.size(found) > 1, found).otherwise(F.array().cast("array<int>"))


def choice_questions(text: Column) -> Column:
    """The numbers of the questions that offer choices A, B and C, each once, in
    order; only if there are two or more such questions."""
    heads = F.regexp_extract_all(text, F.lit(QUESTION), F.lit(0))
    blocks = F.filter(F.split(text, QUESTION), lambda _, i: i > 0)
    offers = F.zip_with(heads, blocks, lambda h, b: F.when(F.size(F.array_intersect(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.regexp_extract_all(b, F.lit(CHOICE), F.lit(1)))) == 3, F.regexp_extract(h, r"\d{1,3}", 0).cast("int")))
    found = F.filter(offers, lambda x: x.isNotNull())
    return F.when(F.size(found) > 1, F.array_distinct(found)).otherwise(F.array().cast("array<int>"))


def source_quality(address: Column, authority: Column) -> Column:
    """1.0 for public and scholarly institutions, 0.85 where the authority is 3 or more, else 0.6."""
    return F.when(is_primary(address), 1.0).when(F.coalesce(authority, F.lit(-1)) >= 3, 0.85).otherwise(0.6)


def question_coverage(answered: Column, expected: Column) -> Column:
    """struct(answered, missing) of the expected numbers."""
    return F.struct(F.array_intersect(expected, answered).alias("answered"), F.array_except(expected, answered).alias("missing"))
