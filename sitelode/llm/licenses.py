"""License scan by canonical digests.

Texts are brought to one canonical form (case, punctuation, copyright lines, equivalent spellings), digested, and joined by hash
with the digests of known license texts. A document is looked up as a whole and line by line, so that a notice that
stands on a line of its own is found as the entire text that it is.

Full texts, those of at least ``FULL_WORDS`` words, are found wherever they stand in a document and however its lines are broken:
documents join them by hash on the longest word of each, and those that meet are compared as entire texts.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import durable

# Spellings that license matching treats as equal, British or variant form to the form kept.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sub-license", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
# License names with the versions in use, and the forms of notice that name them.
NAMES = (
    ("MIT", "MIT License", ("",)), ("Apache", "Apache License", ("1.1", "2.0")), ("GPL", "GNU General Public License", ("1", "2", "3")),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",)),
    ("MPL", "Mozilla Public License", ("1.1", "2.0")), ("EPL", "Eclipse Public License", ("1.0", "2.0")), ("ISC", "ISC License", ("",)),
    ("BSD-2-Clause", "BSD 2-Clause License", ("",)), ("BSD-3-Clause", "BSD 3-Clause License", ("",)), ("Zlib", "zlib License", ("",)),
    ("BSL", "Boost Software License", ("1.0",)), ("Unlicense", "Unlicense", ("",)), ("CC0", "CC0", ("1.0",)),
    ("CC-BY", "CC BY", ("2.0", "2.5", "3.0", "4.0")), ("CC-BY-SA", "CC BY-SA", ("2.0", "2.5", "3.0", "4.0")),
    ("CC-BY-ND", "CC BY-ND", ("2.0", "2.5", "3.0", "4.0")), ("CC-BY-NC", "CC BY-NC", ("2.0", "2.5", "3.0", "4.0")),
    ("CC-BY-NC-SA", "CC BY-NC-SA", ("2.0", "2.5", "3.0", "4.0")), ("CC-BY-NC-ND", "CC BY-NC-ND", ("2.0", "2.5", "3.0", "4.0")),
)
NOTICES = ("Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.",
           "This work is licensed under {}.", "{}")
COPYRIGHT = r"(?m)^[ \t/*#;-]*(copyright|\(c\)|©)[^\n]*$"
# The same for full texts, whose lines may break before this word: not where a text goes on with it.
COPYRIGHT_LINES = (r"(?m)^[ \t/*#;-]*(?:(?:copyright\b(?![ \t]*$|[ \t,]+(?:and|disclaimer|doctrine|grant|holder|in|interest|is|law|license|licence|notice|on|or|owner|permission"
                   r"|statement|to|treaty)s?\b)|\(c\)(?=[ \t]*(?:[0-9]|by\b|copyright))|©)[^\n]*|all rights reserved\.?[ \t\r]*)$")
# Words from which a text is found anywhere in a document; shorter ones must be a whole line.
FULL_WORDS = 20
# Largest table of full texts that is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
TEXTS = Path(__file__).parent / "texts"


def known_texts() -> list[tuple[str, str]]:
    """``(license_id, text)`` of the notices that follow from the names, versions and forms above."""
    found = []
    for short, name, versions in NAMES:
        for version in versions:
            named = [f"{name}, Version {version}", f"{name} {version}", f"{name} v{version}"] if version else [name]
            found += [(f"{short}-{version}" if version else short, form.format(x)) for x in named for form in NOTICES]
    return found


def full_texts() -> list[tuple[str, str]]:
    """``(license_id, text)`` of the license texts and headers in ``texts/``: as they are, without a title line or the
    copyright of the license itself, and without what follows their terms."""
    found = []
    for file in sorted(TEXTS.glob("*.txt")):
        license_id, text = file.name.removesuffix(".txt").removesuffix(".header"), file.read_text(encoding="utf-8")
        title, _, body = text.partition("\n\n")
        forms = {text, body if "\n" not in title and "License" in title else text}
        forms |= {x.partition("document, but changing it is not allowed.")[2] or x for x in forms}
        forms |= {x.partition("END OF TERMS AND CONDITIONS")[0] for x in forms}
        found += [(license_id, x) for x in sorted(forms)]
    return found


def canonical(text: Column, without: str = COPYRIGHT) -> Column:
    """Canonical form line by line: lower case, no copyright lines, one blank for each run of other characters
    than letters, digits, dots within numbers and line ends, equivalent spellings made one."""
    plain = F.regexp_replace(F.lower(text), without, "")
    for variant, kept in SPELLINGS:
        if "-" in variant:
            plain = F.when(plain.contains(variant), F.replace(plain, F.lit(variant), F.lit(kept))).otherwise(plain)
    plain = F.regexp_replace(plain, r"[\x00-\x09\x0B-\x1F\x21-\x2D\x2F\x3A-\x60\x7B-\x7F]+|\.(?![0-9])", " ")
    return F.regexp_replace(plain, "  +", " ")


def respelled(unit: Column) -> Column:
    """Equivalent spellings of one canonical unit made one."""
    variants = [(a, b) for a, b in SPELLINGS if "-" not in a]
    changed = unit
    for a, b in variants:
        changed = F.regexp_replace(changed, rf"\b{a}\b", b)
    return F.when(unit.rlike(r"\b(" + "|".join(a for a, _ in variants) + r")\b"), changed).otherwise(unit)


def units(text: Column, longest: int) -> Column:
    """Digested units of a text: (whole?, digest) of all of it and of each line.

    Units that are empty, or longer than any canonical text of ``longest`` characters can have been before its spellings
    were made one (no spelling loses more than two characters of five), are left out: they equal no known text.
    """
    lines = F.filter(F.transform(F.split(canonical(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    fits = lambda x: (x != "") & (F.length(x) <= 2 * longest)
    whole = F.when(F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x)) <= 2 * longest, F.array_join(lines, " "))
    listed = F.concat(F.transform(F.filter(F.array(whole), fits), lambda x: F.struct(F.lit(True).alias("whole"), x.alias("unit"))),
                      F.transform(F.filter(lines, fits), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))))
    return F.transform(listed, lambda u: F.struct(u["whole"].alias("whole"), F.md5(respelled(u["unit"]).cast("binary")).alias("digest")))


def _body(text: Column) -> Column:
    """All of a text in canonical form, as one line."""
    lines = F.filter(F.transform(F.split(canonical(text, COPYRIGHT_LINES), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(F.array(F.array_join(lines, " ")), respelled)[0]


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """``digest, license_id, length, word, body`` of known license texts; ``texts``: pairs or a table ``license_id, text``, else the built-in
    notices and full texts. ``body`` is a full text in canonical form and ``word`` its longest word without a second spelling; both are null
    for others."""
    if not isinstance(texts, DataFrame):
        texts = spark.createDataFrame(texts or known_texts() + full_texts(), "license_id string, text string")
    whole = F.array_join(F.filter(F.transform(F.split(canonical(F.col("text")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    known = (texts.select("license_id", whole.alias("unit"), _body(F.col("text")).alias("body")).filter((F.col("unit") != "") | (F.col("body") != ""))
             .select(respelled(F.col("unit")).alias("unit"), "license_id", "body"))
    full = known.withColumn("words", F.split("body", " ")).filter(F.size("words") >= FULL_WORDS).groupBy("body", "words").agg(F.min("license_id").alias("license_id"))
    spelled = [x for pair in SPELLINGS for x in pair]
    longest = F.array_max(F.transform(F.filter("words", lambda w: ~w.isin(spelled)), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    full = full.select(F.md5(F.col("body").cast("binary")).alias("digest"), "license_id", F.length("body").alias("length"),
                       F.coalesce(longest, F.lit("")).alias("word"), "body")
    short = known.filter(F.size(F.split("body", " ")) < FULL_WORDS).filter(F.col("unit") != "").groupBy(F.md5(F.col("unit").cast("binary")).alias("digest")).agg(
        F.min("license_id").alias("license_id"), F.max(F.length("unit")).alias("length"))
    return short.unionByName(full, allowMissingColumns=True)


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, n_licenses, licenses, whole`` per row of ``docs`` (``doc_id, text``).

    ``licenses``: ids of the known texts that equal the document or one of its lines, and of the full texts that stand in it, sorted,
    comma-joined, empty if none; ``whole``: the entire document is a known text. Null and empty texts match nothing; repeated rows are
    returned each; texts known under two ids count as the smaller. The known texts are joined by hash and broadcast if they are small.
    """
    known = durable(known)  # read several times
    short = known.filter(F.col("body").isNull()).select("digest", "license_id", "length")
    full = known.filter(F.col("body").isNotNull()).select("word", F.col("license_id").alias("full_id"), F.col("body").alias("full"))
    longest = short.agg(F.max("length")).first()[0] or 0
    words = sorted((r["word"], r["size"]) for r in full.groupBy("word").agg(F.sum(F.octet_length("full")).alias("size")).collect())
    text, unit = F.col("text"), "array<struct<whole:boolean,digest:string,word:string>>"
    none = F.lit(None).cast("string")
    met = F.array_compact(F.array(*[F.when(F.col("low").contains(w), F.lit(w)) for w, _ in words])) if words else F.array().cast("array<string>")
    us = F.concat(F.array(F.struct(F.lit(None).cast("boolean").alias("whole"), none.alias("digest"), none.alias("word"))),
                  F.transform(F.coalesce(units(text, longest), F.array().cast("array<struct<whole:boolean,digest:string>>")),
                              lambda u: F.struct(u["whole"].alias("whole"), u["digest"].alias("digest"), none.alias("word"))),
                  F.transform("met",
                              lambda w: F.struct(F.lit(None).cast("boolean").alias("whole"), none.alias("digest"), w.alias("word"))))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), F.lower("text").alias("low")).select(
        "doc_id", "text", "row", met.alias("met"))
    rows = rows.select("doc_id", "row", us.cast(unit).alias("us"), F.when(F.size("met") > 0, _body(text)).alias("body"))
    rows = rows.select("doc_id", "row", "body", F.explode("us").alias("u")).select(
        "doc_id", "row", "u.whole", "u.digest", "u.word", F.when(F.col("u.word").isNotNull(), F.col("body")).alias("body"))
    found = rows.join(short.drop("length"), "digest", "left").filter(F.col("digest").isNull() | F.col("license_id").isNotNull())
    if words:
        full = F.broadcast(full) if sum(size for _, size in words) <= BROADCAST_BYTES else full
        # A full text stands in the document from word to word.
        padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
        found = found.join(full.withColumn("known_word", F.col("word")).drop("word"), (F.col("word") == F.col("known_word")) & padded("body").contains(padded("full")), "left")
        found = found.withColumn("whole", F.when(F.col("full_id").isNotNull(), F.col("body") == F.col("full")).otherwise(F.col("whole")))
        found = found.withColumn("license_id", F.coalesce("license_id", "full_id"))
    return found.groupBy("row", "doc_id").agg(
        F.sort_array(F.collect_set("license_id")).alias("ids"),
        F.coalesce(F.bool_or(F.col("whole") & F.col("license_id").isNotNull()), F.lit(False)).alias("whole")).select(
        "doc_id", F.size("ids").cast("long").alias("n_licenses"), F.array_join("ids", ",").alias("licenses"), "whole")
