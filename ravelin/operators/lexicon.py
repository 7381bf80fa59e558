"""Lexical scan of review-like text with families of patterns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import text as tx


def compile_family(patterns: Sequence[str], lists: Mapping[str, Sequence[str]]) -> str:
    """One alternation of patterns, {name} standing for any word of a list."""
    out = []
    for p in patterns:
        for name, words in lists.items():
            p = p.replace("{" + name + "}", "(?:" + "|".join(words) + ")")
        out.append(f"(?:{p})")
    return "|".join(out)


def scan(df: DataFrame, families: Mapping[str, str], captures: Mapping[str, str] | None = None, text: str = "text", title: str | None = None, evidence: str | None = None, against: str | None = None) -> DataFrame:
    """df without its text, with a flag kw_<family> for each family; with evidence
    and against, kw_proxy (evidence and not against), the share of the text that
    lies before the first evidence (bytes over characters, so beyond 1 is
    possible for text that is not ASCII) and, given a title, whether it lies there;
    with captures, the first group of each (null without a match)."""
    hay = F.coalesce(F.col(text), F.lit(""))
    if title:
        hay = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), hay)
    df = df.withColumn("__hay", hay)
    h = F.col("__hay")
    new = {f"kw_{k}": tx.has(h, rx) for k, rx in families.items()}
    new["text_len_chars"] = F.char_length(h).cast("long")
    if evidence:
        e = families[evidence]
        new["kw_proxy"] = tx.has(h, e) & (~tx.has(h, families[against]) if against else F.lit(True))
        new["kw_pos_rel"] = tx.byte_offset(h, tx.find(h, e)) / F.nullif(F.char_length(h), F.lit(0)).cast("double")
        if title:
            new["kw_in_title"] = tx.has(F.coalesce(F.col(title), F.lit("")), e)
    for name, rx in (captures or {}).items():
        new[f"kw_{name}"] = F.lower(tx.capture(h, rx))
    return df.withColumns(new).drop("__hay", text, *([title] if title else []))


def rates(flags: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, family, n, n_hits, rate) for each flag."""
    g = flags.groupBy(*by) if by else flags.groupBy()
    one = g.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c)).alias(c) for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("family"), F.col(c).alias("n_hits")) for c in columns])
    out = one.select(*by, "n", F.explode(each).alias("s"))
    return out.select(*by, "s.family", "n", "s.n_hits", (F.col("s.n_hits") / F.nullif(F.col("n"), F.lit(0))).alias("rate"))


def inflation(flags: DataFrame, naive: Column, proxy: Column) -> DataFrame:
    """One row: rates of any hit and of the proxy, and how often the first is the second."""
    r = flags.agg(F.avg(naive.cast("double")).alias("naive_rate"), F.avg(proxy.cast("double")).alias("proxy_rate"))
    return r.withColumn("inflation", F.col("naive_rate") / F.nullif(F.col("proxy_rate"), F.lit(0.0)))
