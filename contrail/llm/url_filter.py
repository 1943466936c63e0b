"""URL filter: host words by unigram Viterbi, then multinomial naive Bayes over host and path tokens.

Word counts come from the text of all pages; seed terms and their inflections count once more, so that hosts are split at them
even if no page has them. Host labels are cut at everything but letters; each distinct run of letters is joined, by its
substrings, with the counts and split into its likeliest words. A url is bad for training if one of its tokens is a seed term or
an inflection of one, or if several such words make up a fiftieth of its page's words; naive Bayes over all urls then learns what else goes with
such names, and judges the urls that no rule decides, with or without a seed term in them. Model and segmentation stay tables
throughout; nothing of them is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import column, let, stage

#: Fixed values: (verdict, rule); a rule is host and path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Terms that mark a url or a page as bad for training.
SEEDS = (
    "adult", "bet", "bingo", "blackjack", "camgirl", "casino", "cialis", "clickbait", "crack", "escort", "gambling", "hentai", "hookup", "jackpot", "keygen", "loan", "lottery",
    "malware", "milf", "nude", "payday", "phishing", "pills", "poker", "porn", "ransomware", "roulette", "scam", "sex", "slots", "spam", "spyware", "torrent", "viagra", "wager", "warez", "xxx",
)
#: Share of seed terms among a page's words that marks its url.
SHARE = 0.02
#: Letters of a host that are looked up as one word: no label of a host name holds more (a fixed value of DNS).
LONGEST = 63
#: Common runs of letters (com, www) and tokens meet their words and weights in so many parts.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.regexp_extract(url, _PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def inflections(seed: str) -> set[str]:
    """The term and its regular forms: plural (of a plural the singular), -ed and -ing; of a term in -ing those of its verb."""
    if seed.endswith("ing") and len(seed) > 5:
        verb = seed[:-3]
        return {seed, seed + "s", *(verb + x for x in ("e", "es", "ed"))}
    out = {seed, seed + ("es" if seed.endswith(("s", "x", "z", "ch", "sh", "o")) else "s"), seed + "s"}
    if seed.endswith("s") and not seed.endswith("ss"):
        return out | {seed[:-1]}
    if seed.endswith("y") and seed[-2:-1] not in tuple("aeiou"):
        return out | {seed[:-1] + x for x in ("ies", "ied")} | {seed + "ing"}
    vowels = [c in "aeiou" for c in seed]
    doubled = vowels[-3:] == [False, True, False] and sum(vowels) == 1 and seed[-1] not in "wxy"
    root = seed + seed[-1] if doubled else seed.removesuffix("e")
    return out | {root + "ed", root + "ing"}


def page_words(html: Column) -> Column:
    """All runs of a-z, lower-cased, outside the tags; null: none."""
    text = F.translate(F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]*>", " "), UPPER, LOWER)
    return F.filter(F.split(text, "[^a-z]+"), lambda w: w != "")


def word_counts(html: DataFrame, known: Iterable[str] = ()) -> DataFrame:
    """(word, count) of the words of html(html), and of the known ones."""
    words = html.select(F.explode(page_words(F.col("html"))).alias("word"))
    words = words.unionByName(html.sparkSession.createDataFrame([(w,) for w in known], "word string"))
    return words.groupBy("word").agg(F.count("*").alias("count"))


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on key where left has few very common keys: its rows are dealt by another column, right's are repeated."""
    left = left.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "salt"]).drop("salt")


def split_words(text: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest split under unigram probabilities; an unknown letter costs as a word seen once in ten times the corpus."""
    unknown = -math.log(10.0 * (total + 1))
    best, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        top, at = best[end - 1] + unknown, end - 1
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(text[start:end])
            if n:
                score = best[start] + math.log(n / total)
                if score > top:
                    top, at = score, start
        best.append(top)
        back.append(at)
    out, end = [], len(text)
    while end:
        out.append(text[back[end] : end])
        end = back[end]
    return out[::-1]


def _split(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk, known in zip(column(batch, "chunk").to_pylist(), column(batch, "known").to_pylist(), strict=True):
                out.append(split_words(chunk, {k["word"]: k["count"] for k in known or ()}, max(total, 1)))
            yield pa.RecordBatch.from_arrays([column(batch, "chunk"), pa.array(out, pa.list_(pa.string()))], ["chunk", "words"])

    return run


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) for hosts(host)."""
    total, longest = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max(F.length("word")), F.lit(1))).first()
    parts = hosts.select("host", F.posexplode(F.filter(F.split("host", "[^a-z]+"), lambda x: x != "")).alias("at", "chunk"))
    chunks = stage(parts.select("chunk").distinct())
    starts, most = F.sequence(F.lit(1), F.length("chunk")), F.lit(min(longest, LONGEST))
    pieces = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(most, F.length("chunk") - i + 1)), lambda n: F.substring(F.col("chunk"), i, n)))))
    found = chunks.select("chunk", F.explode(pieces).alias("word")).join(counts, "word")
    known = found.groupBy("chunk").agg(F.collect_list(F.struct("word", "count")).alias("known"))
    split = stage(chunks.join(known, "chunk", "left").mapInArrow(_split(total), "chunk string, words array<string>"))
    words = salted_join(parts, split, "chunk", "host").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("parts"))
    return words.select("host", F.flatten(F.transform("parts", lambda x: x["words"])).alias("words"))


def path_tokens(path: Column) -> Column:
    """Runs of letters and digits, lower-cased; numbers all count as one token."""
    parts = F.filter(F.split(F.translate(path, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("0")).otherwise(x))


def learn(urls: DataFrame, seeds=SEEDS) -> tuple[DataFrame, float]:
    """Weights (token, weight) and the log odds of the classes from urls(host, path, times, tokens, bad); seeds count as one bad url."""
    each = urls.select("bad", "times", F.explode("tokens").alias("token"))
    prior = urls.sparkSession.createDataFrame([(s,) for s in seeds], "token string").select("token", F.lit(1).cast("long").alias("b"), F.lit(0).cast("long").alias("g"))
    counts = each.select("token", F.when(F.col("bad"), F.col("times")).otherwise(0).alias("b"), F.when(F.col("bad"), 0).otherwise(F.col("times")).alias("g"))
    counts = stage(counts.unionByName(prior).groupBy("token").agg(F.sum("b").alias("b"), F.sum("g").alias("g")))
    tokens_bad, tokens_good, kinds = counts.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("g"), F.lit(0)), F.count("*")).first()
    urls_bad, urls_good = urls.agg(F.coalesce(F.sum(F.when(F.col("bad"), F.col("times"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("bad"), F.col("times"))), F.lit(0))).first()
    weight = F.log((F.col("b") + 1.0) / float(tokens_bad + kinds)) - F.log((F.col("g") + 1.0) / float(tokens_good + kinds))
    return counts.select("token", weight.alias("weight")), math.log((urls_bad + 1) / (urls_good + 1))


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of pages(page_id, url, html).

    Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end;
    null urls and urls without `://` have both empty. The longest rule that fits host (or a parent domain) and path start decides;
    else block if the naive Bayes log odds (score) are above 0. Null html counts no words; urls without tokens
    have the odds of the classes; urls and pages of any length are read whole. Null page_ids and repeated rows stay, each row of a
    url counts; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    forms = sorted({form for seed in seeds for form in inflections(seed)})
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    words = page_words(F.col("html").cast("string"))
    seen = lambda w: let(F.filter(w, lambda x: x.isin(*forms)), lambda s: (F.size(s) > SHARE * F.size(w)) & (F.size(F.array_distinct(s)) > 1))
    marked = let(words, seen) if forms else F.lit(False)
    urls = stage(pages.select(host.alias("host"), path.alias("path"), marked.alias("marked")).groupBy("host", "path").agg(F.count("*").alias("times"), F.max("marked").alias("marked")))
    counts = stage(word_counts(pages.select(F.col("html").cast("string")), forms))
    words = host_words(urls.select("host").distinct(), counts)
    tokens = F.concat(F.coalesce("words", F.array().cast("array<string>")), path_tokens(F.col("path")))
    urls = urls.join(words, "host", "left").withColumn("tokens", tokens)
    bad = F.arrays_overlap("tokens", F.lit(forms).cast("array<string>"))
    urls = stage(urls.select("host", "path", "times", "tokens", (F.coalesce(bad, F.lit(False)) | F.col("marked")).alias("bad")))
    weights, odds = learn(urls, seeds)
    each = urls.select("host", "path", F.xxhash64("host", "path").alias("url"), F.explode("tokens").alias("token"))
    found = salted_join(each, weights, "token", "url").groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    score = F.coalesce("weight", F.lit(0.0)) + odds
    return rows.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score")
    )


def op6(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
