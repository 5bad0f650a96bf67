"""License scans: ordered signature rules in DataFrame functions only.

A text is reduced to its words, A-Z lower-cased.  A rule is a regular
expression over the words, gated by a keyword: the words that are a keyword of
any rule are picked in one pass, a text is searched only for the rules of those,
and texts without any are counted and passed on.  Most rules are sentences of
license texts, headers and notices, written out in ``license_signatures``; the
rest are the ways in which a text speaks of a license by its name.  Every match is an interval of words.  Where intervals
nest, the one of better priority suppresses what it contains (at equal
priority the outer one, then the earlier rule); intervals that only overlap
both stay.  The base phrases take no part in that: they neither suppress nor
are suppressed.

Null and empty texts have no words, no labels and score 0.  The score is the
highest confidence among what stays.  Rows keep their multiplicity.  Very long
texts are searched whole, and an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty
from .license_signatures import SIGNATURES

#: What is not part of a word, before and after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose places are always reported: label, phrase (fixed values).
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Licenses: label, keyword, names as expressions over words.
NAMES = (
    ("mit", "mit", "mit(?: x11)?|x11 mit|expat mit"),
    ("mit-0", "mit", "mit (?:0|no attribution|zero)"),
    ("apache", "apache", "apache(?: software)?"),
    ("apache-1.0", "apache", "apache(?: software)?(?: license)?(?: version| v)? 1 0"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version| v)? 1 1"),
    ("apache-2.0", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?|asl ?2(?: 0)?"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("gpl-1.0", "gpl", "(?:gnu )?gpl ?v?1(?: 0)?"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl(?: version)? ?v?2(?: 0)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl(?: version)? ?v?3(?: 0)?"),
    ("gpl", "general", "gnu general public"),
    ("gpl-2.0", "general", "gnu general public license(?: version| v) ?2(?: 0)?"),
    ("gpl-3.0", "general", "gnu general public license(?: version| v) ?3(?: 0)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version)? ?v?2 1"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl(?: version)? ?v?3(?: 0)?"),
    ("lgpl", "lesser", "gnu lesser general public"),
    ("lgpl", "library", "gnu library general public"),
    ("agpl", "agpl", "(?:gnu )?agpl"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl(?: version)? ?v?3(?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public"),
    ("bsd", "bsd", "bsd(?: style)?"),
    ("bsd-0", "bsd", "(?:0|zero) clause bsd|0bsd"),
    ("bsd-2-clause", "bsd", "(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original|old|4 clause|four clause) bsd|bsd 4 clause"),
    ("mpl", "mozilla", "mozilla public"),
    ("mpl-1.1", "mozilla", "mozilla public license(?: version| v)? 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license(?: version| v)? 2(?: 0)?"),
    ("mpl-2.0", "mpl", "mpl(?: version| v)? ?2(?: 0)?"),
    ("epl", "eclipse", "eclipse public"),
    ("epl-1.0", "eclipse", "eclipse public license(?: version| v)? 1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public license(?: version| v)? 2(?: 0)?"),
    ("edl-1.0", "eclipse", "eclipse distribution"),
    ("cddl", "cddl", "cddl"),
    ("cddl", "common", "common development and distribution"),
    ("cpl-1.0", "common", "common public"),
    ("cpal-1.0", "common", "common public attribution"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("libpng", "libpng", "libpng"),
    ("boost-1.0", "boost", "boost software"),
    ("artistic", "artistic", "artistic"),
    ("artistic-2.0", "artistic", "artistic license(?: version| v)? 2(?: 0)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("psf", "python", "python(?: software foundation)?"),
    ("php", "php", "php"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql"),
    ("ncsa", "ncsa", "ncsa(?: open source)?"),
    ("eupl", "eupl", "eupl(?: v?1 [12])?"),
    ("eupl", "european", "european union public"),
    ("ofl-1.1", "ofl", "ofl(?: 1 1)?"),
    ("ofl-1.1", "font", "sil open font"),
    ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"),
    ("odbl", "odbl", "odbl"),
    ("odbl", "database", "open database"),
    ("gfdl", "gfdl", "gfdl"),
    ("gfdl", "documentation", "gnu free documentation"),
    ("cc0", "cc0", "cc0(?: 1 0)?"),
    ("cc-by", "cc", "cc by(?: [1-4] 0)?"),
    ("cc-by-sa", "cc", "cc by sa(?: [1-4] 0)?"),
    ("cc-by-nd", "cc", "cc by nd(?: [1-4] 0)?"),
    ("cc-by-nc", "cc", "cc by nc(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4] 0)?"),
    ("cc-by", "creative", "creative commons attribution(?: [1-4] 0)?"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1-4] 0)?"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] 0)?"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?"),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] 0)?"),
    ("cc0", "creative", "creative commons zero|creative commons cc0"),
)

#: How a text speaks of a license: word or beginning of one that the form
#: needs, expression around NAME, priority (1 is best), confidence.
FORMS = (
    (" under ", "(?:is |are |be )?(?:licensed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of )?(?:the )?(?:NAME)(?: licen[cs]e)?", 1, 1.0),
    (" terms ", "(?:under|by|to) the terms (?:and conditions )?of (?:the )?(?:NAME)(?: licen[cs]e)?", 1, 1.0),
    (" spdx ", "spdx license identifier (?:NAME)", 1, 1.0),
    (" licen", "(?:NAME) licen[cs]ed?", 2, 0.8),
    (" licen", "licen[cs]e (?:is )?(?:NAME)", 2, 0.7),
)

RULES = "array<struct<rule:int,keyword:string,needs:string,pattern:string,label:string,priority:int,confidence:double,base:boolean>>"


def spaced(expression: str) -> str:
    """Between words stand two spaces, one of either word, so that matches
    beside each other do not share one; around the whole stands one each."""
    return " (?:" + expression.replace("\\ ", "\0").replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?") + ") "


def rules() -> list[dict]:
    """All rules in order: base phrases, signatures, then every form of every name."""
    made = [(" " + phrase.split()[0] + " ", " license ", phrase, label, 2, 0.8, True) for label, phrase in BASE]
    made += [(f" {keyword} ", f" {keyword} ", text, label, 1, 1.0, False) for label, keyword, text in SIGNATURES]
    made += [
        (f" {keyword} ", needs, form.replace("NAME", name), label, priority, sure, False)
        for label, keyword, name in NAMES
        for needs, form, priority, sure in FORMS
    ]
    fields = ("keyword", "needs", "pattern", "label", "priority", "confidence", "base")
    return [{"rule": i} | dict(zip(fields, row, strict=True)) | {"pattern": spaced(row[2])} for i, row in enumerate(made)]


def keywords() -> list[str]:
    """Words of which a text has to hold one for any rule to be tried."""
    return sorted({r["keyword"].strip() for r in rules()})


def words_in(piece: Column) -> Column:
    """Words in a piece that begins and ends between words."""
    return F.shiftright(F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit(""))), 1)


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, n_words`` of every row with, once a match or else null,
    ``rule, label, priority, confidence, base, start_word, end_word, kept``."""
    text = text_or_empty(text_col)
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    joined = F.trim(F.regexp_replace(lower, BETWEEN, "  "))
    listed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), joined.alias("joined"))
    listed = listed.select("row", "id", "joined", F.when(F.col("joined") != "", F.split("joined", "  ")).alias("words"))
    rows = listed.select(
        "row", "id", "joined", F.greatest(F.size("words"), F.lit(0)).cast("bigint").alias("n_words"),
        F.array_intersect("words", F.array(*map(F.lit, keywords()))).alias("present"),
    )
    rows = rows.select("row", "id", "n_words", "present", F.when(F.size("present") > 0, F.concat(F.lit(" "), "joined", F.lit(" "))).alias("padded"))
    whole = F.col("padded")
    tried = F.filter(
        F.from_json(F.lit(json.dumps(rules())), RULES),
        lambda r: F.array_contains("present", F.trim(r["keyword"])) & F.contains(whole, r["needs"]),
    )

    def search(rule: Column) -> Column:
        """The words before each match, after the one before it, and in it."""
        return F.struct(
            *(rule[f].alias(f) for f in ("rule", "label", "priority", "confidence", "base")),
            F.arrays_zip(
                F.transform(F.regexp_extract_all(whole, rule["pattern"], F.lit(0)), words_in).alias("size"),
                F.transform(F.split(whole, rule["pattern"]), words_in).alias("gap"),
            ).alias("places"),
        )

    hits = F.filter(F.transform(tried, search), lambda h: F.size(h["places"]) > 1)
    found = rows.select("row", "id", "n_words", F.when(whole.isNotNull(), hits).alias("hits"))
    matches = (
        found.select("row", "id", "n_words", F.inline_outer("hits"))
        .select("*", F.posexplode_outer("places").alias("place", "part"))
        .where("place is null or part.size is not null")  # behind the last match comes a gap only
        .select("row", "id", "n_words", "rule", "label", "priority", "confidence", "base", "place", "part.gap", "part.size")
        .repartition("row")
    )
    run = Window.partitionBy("row", "rule").orderBy("place")
    placed = matches.withColumn("end_word", F.sum(F.col("gap") + F.col("size")).over(run))
    placed = placed.withColumn("start_word", F.col("end_word") - F.col("size"))
    outer = Window.partitionBy("row").orderBy("start_word", F.desc("end_word"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)

    def reach(priority: int) -> Column:
        """How far a match of this priority or a better one that starts no later goes."""
        return F.max(F.when((F.col("priority") <= priority) & ~F.col("base"), F.col("end_word"))).over(outer)

    levels = sorted({r["priority"] for r in rules()})
    held = F.coalesce(*(F.when(F.col("priority") == p, F.coalesce(reach(p) >= F.col("end_word"), F.lit(False))) for p in levels), F.lit(False))
    return placed.withColumn("kept", F.col("base") | ~held)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, n_detections`` of every row."""
    found = detections(docs, id_col, text_col)
    base, kept = F.col("base") & F.col("place").isNotNull(), F.col("kept") & F.col("place").isNotNull()

    def labels(which: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return (
        found.groupBy("row")
        .agg(
            F.first("id").alias("id"),
            F.first("n_words").alias("n_words"),
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("start_word"))).alias("first_word"),
            F.max(F.when(base, F.col("start_word"))).alias("last_word"),
            labels(base).alias("base_labels"),
            labels(kept).alias("labels"),
            F.coalesce(F.max(F.when(kept, F.col("confidence"))), F.lit(0.0)).alias("score"),
            F.count_if(kept).alias("n_detections"),
        )
        .drop("row")
    )


def oracle() -> str:
    """The same in DuckDB: matches by lazy prefixes, intervals by running sums,
    and suppression by comparing every two matches of a text."""
    values = ",\n".join(
        "({rule}, '{keyword}', '{needs}', '{pattern}', '{label}', {priority}, {confidence}::DOUBLE, {base})".format(**r) for r in rules()
    )
    return rf"""
WITH rules(rule, keyword, needs, pattern, label, priority, confidence, base) AS (VALUES {values}),
texts AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n_words,
    ' ' || trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BETWEEN}', '  ', 'g'), ' ') || ' ' AS padded
  FROM documents),
hits AS (
  SELECT doc_id, rule, label, priority, confidence, base, pattern, padded
  FROM texts JOIN rules ON contains(padded, keyword) AND contains(padded, needs)),
parts AS (
  SELECT doc_id, rule, label, priority, confidence, base,
    unnest(regexp_extract_all(padded, '(?s)(.*?)(' || pattern || ')', 1)) AS gap,
    unnest(regexp_extract_all(padded, '(?s)(.*?)(' || pattern || ')', 2)) AS hit,
    generate_subscripts(regexp_extract_all(padded, '(?s)(.*?)(' || pattern || ')', 2), 1) AS place
  FROM hits),
sized AS (
  SELECT *, (length(gap) - length(replace(gap, ' ', ''))) // 2 AS n_gap, (length(hit) - length(replace(hit, ' ', ''))) // 2 AS n_hit FROM parts),
found AS (
  SELECT *, sum(n_gap + n_hit) OVER (PARTITION BY doc_id, rule ORDER BY place) - n_hit AS s,
    sum(n_gap + n_hit) OVER (PARTITION BY doc_id, rule ORDER BY place) AS e FROM sized),
kept AS (
  SELECT * FROM found a WHERE base OR NOT EXISTS (
    SELECT 1 FROM found b WHERE b.doc_id = a.doc_id AND NOT b.base AND b.s <= a.s AND b.e >= a.e AND b.priority <= a.priority
      AND (b.s < a.s OR b.e > a.e OR b.priority < a.priority OR b.rule < a.rule)))
SELECT t.doc_id, any_value(t.n_words) AS n_words,
  count(*) FILTER (WHERE k.base) AS n_base,
  CAST(min(k.s) FILTER (WHERE k.base) AS BIGINT) AS first_word, CAST(max(k.s) FILTER (WHERE k.base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT k.label, ',' ORDER BY k.label) FILTER (WHERE k.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT k.label, ',' ORDER BY k.label) FILTER (WHERE k.rule IS NOT NULL), '') AS labels,
  coalesce(max(k.confidence), 0.0) AS score, count(k.rule) AS n_detections
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id GROUP BY t.doc_id
"""
