"""robots.txt bodies to rule rows, without leaving the row that holds the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import trim_space
from ..functions.urls import percent_decode

_NEWLINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# One token line per directive: U agent, A allow, D disallow, X other rule, B blank line.
_GROUP = r"(?:U:[^\n]*+\n)++(?:[ADX]:[^\n]*+\n)++"
_KINDS = {"user-agent": "U", "allow": "A", "disallow": "D", "crawl-delay": "X", "request-rate": "X", "sitemap": "S"}


def _lines(body) -> Column:
    return F.split(F.coalesce(F.col(body), F.lit("")), _NEWLINE)


def _field(line: Column) -> Column:
    return F.lower(trim_space(F.regexp_extract(F.regexp_replace(line, "#.*$", ""), r"^([^:]*):", 1)))


def _value(line: Column) -> Column:
    return trim_space(F.regexp_extract(F.regexp_replace(line, "#.*$", ""), r"^[^:]*:(.*)$", 1))


def _token(line: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    kind = F.try_element_at(kinds, _field(line))
    return F.when(line == "", "B:").when(kind.isNotNull() & (kind != "S"), F.concat(kind, F.lit(":"), _value(line)))


def robots_arrays(df: DataFrame, agent: str = "*") -> DataFrame:
    """``host, rules``: the ordered rules that apply to ``agent``, as one array per file.

    A group is a run of user-agent lines followed directly by rules; a blank line ends it. The first
    group naming ``agent`` applies, else the first ``*`` group. An empty ``Disallow`` allows
    everything from its position on. A file not served with status 200 has no rules.
    """
    tokens = F.concat(F.array_join(F.filter(F.transform(_lines("body"), _token), lambda t: t.isNotNull()), "\n"),
                      F.lit("\n"))
    groups = F.when(F.col("status") == 200, F.regexp_extract_all(tokens, F.lit(_GROUP), F.lit(0))).otherwise(
        F.array().cast("array<string>"))

    def names(group: Column) -> Column:
        return F.transform(F.regexp_extract_all(group, F.lit(r"(?m)^U:(.*)$"), F.lit(1)), percent_decode)

    default = F.get(F.filter("_groups", lambda g: F.array_contains(names(g), "*")), F.lit(0))
    wanted = agent.split("/")[0].lower()
    if wanted == "*":
        chosen = default
    else:
        own = F.get(F.filter("_groups", lambda g: ~F.array_contains(names(g), "*") & F.exists(
            names(g), lambda n: F.lit(wanted).contains(F.lower(n)))), F.lit(0))
        chosen = F.coalesce(own, default)
    lines = F.regexp_extract_all(F.coalesce(chosen, F.lit("")), F.lit(r"(?m)^[AD]:.*$"), F.lit(0))

    def rule(line: Column) -> Column:
        prefix = percent_decode(F.substr(line, F.lit(3)))
        return F.struct((line.startswith("A") | (prefix == "")).alias("allow"), prefix.alias("prefix"))

    return df.withColumn("_groups", groups).select("host", F.transform(lines, rule).alias("rules"))


def parse_robots(df: DataFrame, agent: str = "*") -> DataFrame:
    """``host, seq, allow, prefix`` rule rows in file order (``seq`` from 1)."""
    return (
        robots_arrays(df, agent).select("host", F.posexplode("rules").alias("_pos", "_rule"))
        .select("host", (F.col("_pos") + 1).alias("seq"), F.col("_rule.allow").alias("allow"),
                F.col("_rule.prefix").alias("prefix"))
    )


def robots_sitemaps(df: DataFrame) -> DataFrame:
    """``host, sitemap_url`` of every Sitemap line, wherever it stands."""
    listed = F.filter(_lines("body"), lambda line: _field(line) == "sitemap")
    return (
        df.filter(F.col("status") == 200)
        .select("host", F.explode(F.transform(listed, lambda line: percent_decode(_value(line)))).alias("sitemap_url"))
        .filter(F.col("sitemap_url") != "")
    )
