"""URL filters: host and path rules, then a weighted vocabulary counted by Aho-Corasick.

A term counts where no ASCII letter or digit stands directly before or after it. A url is blocked by
one strict term or by ``SOFT_LEAST`` distinct soft ones. Edge cases: a null url, or one without
``://``, has an empty host and path and no rule; a null url has no hits and is allowed. Rows repeat
as they come; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host, path, verdict. Fixed values of the query's contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
STRICT = ("porn", "xxx", "hentai", "milf", "camgirls", "escorts", "warez", "keygen", "phishing", "ransomware", "malware", "botnet")
SOFT = ("adult", "bet", "bonus", "casino", "cheap", "coupon", "crack", "dating", "deal", "farm", "free", "gambling", "loan", "lottery", "nude", "pharma", "pills", "poker", "replica", "sex", "slots", "spam", "torrent", "viagra", "webcam", "win")
SOFT_LEAST = 2

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOW)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the last that fits wins, and is the longest
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def term_counter(strict: tuple[str, ...], soft: tuple[str, ...]):
    """A Pandas UDF: url to (strict hits, distinct soft hits). Each task builds the automaton once."""

    @F.pandas_udf("n_strict long, n_soft long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        find = ahocorasick.Automaton()
        for kind, terms in (("soft", soft), ("strict", strict)):
            for t in terms:
                find.add_word(t, (t, kind))
        find.make_automaton()
        edge = set("abcdefghijklmnopqrstuvwxyz0123456789")
        low = str.maketrans(_UPPER, _LOW)

        def one(url: str | None) -> tuple[int, int]:
            if not url:
                return 0, 0
            url, n, seen = url.translate(low), 0, set()
            for end, (t, kind) in find.iter(url):
                at = end - len(t)
                if (at >= 0 and url[at] in edge) or (end + 1 < len(url) and url[end + 1] in edge):
                    continue
                if kind == "strict":
                    n += 1
                else:
                    seen.add(t)
            return n, len(seen)

        for s in batches:
            yield pd.DataFrame([one(x if isinstance(x, str) else None) for x in s], columns=["n_strict", "n_soft"])

    return count


def judge(df: DataFrame, ident: str = "page_id", url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_least: int = SOFT_LEAST) -> DataFrame:
    """Per row: ident, host, path, rule, verdict, n_strict, n_soft."""
    base = df.select(F.col(ident).alias(ident), F.col(url).alias("_url"))
    host, path = host_path(F.col("_url"))
    base = base.withColumns({"host": host, "path": path, "_hits": term_counter(strict, soft)(F.col("_url"))})
    rule, said = best_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("_hits.n_strict") >= 1) | (F.col("_hits.n_soft") >= soft_least), "block").otherwise("allow")
    return base.select(ident, "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), F.col("_hits.n_strict").alias("n_strict"), F.col("_hits.n_soft").alias("n_soft"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    low = f"translate(url, '{_UPPER}', '{_LOW}')"
    rx = lambda t: f"(^|[^a-z0-9]){t}([^a-z0-9]|$)"
    # a hit's right edge may be the next one's left edge, so each term is counted by itself
    strict = " + ".join(f"(len(regexp_split_to_array(regexp_replace(l, '([^a-z0-9])', '\\1\\1', 'g'), '{rx(t)}')) - 1)" for t in STRICT)
    soft = " + ".join(f"regexp_matches(l, '{rx(t)}')::BIGINT" for t in SOFT)
    fits = [(f"{h}{p}", f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for r, c, _ in fits)
    said = " ".join(f"WHEN {c} THEN '{v}'" for _, c, v in fits)
    return f"""
WITH a AS (SELECT page_id, coalesce({low}, '') AS l,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, l, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOW}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE WHEN l = '' THEN 0 ELSE ({strict}) END::BIGINT AS n_strict, ({soft})::BIGINT AS n_soft FROM b)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {said} WHEN n_strict >= 1 OR n_soft >= {SOFT_LEAST} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft FROM c"""


SQL = _sql()
