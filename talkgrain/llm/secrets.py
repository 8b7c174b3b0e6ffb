"""Secrets in texts, told from widely copied examples by corpus-wide ownership frequency.

DataFrame functions only. Base candidates come from fixed patterns, further ones from the shapes in MORE. Every candidate
value is counted over the whole corpus by the distinct owners and repositories that hold it: a value that few owners have
is live-looking, one that many have is an example. Base spans always stay; further spans count only if live-looking.
The value of a private key is its base64 body without line breaks, its span the whole block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.common import keyed, materialize
from talkgrain.llm.spans import find, listing

#: fixed values: kind, pattern, group that holds the value, least length of the value
BASE = [
    ("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
]
#: line breaks, as they are or escaped
_BREAK = "(?:\\s|\\\\[nr])"
_END = "-----END [A-Z ]{0,30}PRIVATE KEY-----"
#: a whole block of header, attributes, body (the group) and end; if the end is missing, to the end of the base64 lines. The
#: loops are possessive, which Java runs without recursion
_PEM = (
    f"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----(?:{_BREAK}*+(?:Proc-Type: ?[0-9],[A-Z]+|DEK-Info: ?[A-Z0-9-]+(?:,[0-9A-Fa-f]+)?))*+"
    f"((?:[A-Za-z0-9+/=\\s\\\\]*+(?={_END}))|(?:{_BREAK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+(?:(?:\\r?\\n|\\\\n)[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=\\r?\\n|\\\\n|$))?)"
    f"(?:{_END})?"
)
MORE = [
    ("pem", _PEM, 1, 0),
    ("jwt", "(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("prefixed", "(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{30,}|sk_live_[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})", 0, 1),
]
#: a value that so many owners hold is an example
MANY_OWNERS = 3


def scan(docs: DataFrame, owner: str = "source", repository: str | None = None, many_owners: int = MANY_OWNERS) -> DataFrame:
    """doc_id, base and all (arrays of spans with kind, start, end, live, owners), text untouched and not returned.

    `docs` needs doc_id, text and the owner column; `repository` defaults to the document itself. Null or empty texts have no
    spans; a null owner is one owner of its own; null and repeated doc_ids give a row per row. An empty table gives an
    empty result. Positions are code points, ends exclusive.
    """
    repo = F.col(repository).cast("string") if repository else F.col("doc_id").cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = [(k, *x, k < len(BASE)) for k, x in enumerate(BASE + MORE)]
    own = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(repo, F.lit("")).alias("repo"))
    def candidates(k, kind, pattern, group, least, base):
        kept = F.filter(find(F.col("text"), pattern, group), lambda x: F.length(x["value"]) >= least)
        value = (lambda v: F.regexp_replace(v, _BREAK, "")) if kind == "pem" else (lambda v: v)
        return F.transform(kept, lambda x: F.struct(x["start"], F.lit(k).alias("k"), F.lit(kind).alias("kind"), x["end"], F.lit(base).alias("base"), F.xxhash64(value(x["value"])).alias("value")))

    each = [candidates(*x) for x in kinds]
    found = materialize(own.select("doc_id", "owner", "repo", F.monotonically_increasing_id().alias("row"), F.concat(*each).alias("spans")), "candidates")
    held = found.where(F.size("spans") > 0).select("row", "owner", "repo", F.explode("spans").alias("x"))
    # two partial aggregations: a value that a third of all rows hold is one row per task before any shuffle
    by_repo = held.groupBy(F.col("x.value").alias("value"), "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    spread = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    judged = held.select("row", "x.*").join(spread, "value").withColumn("live", F.col("owners") < many_owners)
    item = F.struct("start", "k", "kind", "end", "live", "owners", "repos", "base")
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("judged"))
    out = found.select("doc_id", "row").join(by_row, "row", "left")
    nothing = F.expr("cast(array() as array<struct<start:bigint,k:int,kind:string,end:bigint,live:boolean,owners:bigint,repos:bigint,base:boolean>>)")
    judged = F.coalesce("judged", nothing)
    return out.select("doc_id", F.filter(judged, lambda x: x["base"]).alias("base"), F.filter(judged, lambda x: x["base"] | x["live"]).alias("all"))


def summary(scanned: DataFrame) -> DataFrame:
    """The digest columns of `scan`: counts by kind, hash of the base spans, all spans, live and copied candidates."""
    count = lambda col, f: F.size(F.filter(col, f)).cast("long")
    is_kind = lambda kind: lambda x: x["kind"] == kind
    return scanned.select(
        "doc_id",
        *[count("base", is_kind(kind)).alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(listing(F.col("base")), 256).alias("base_sha256"),
        listing(F.col("all")).alias("spans"),
        count("all", lambda x: x["live"]).alias("n_live"),
        count("all", lambda x: ~x["live"]).alias("n_copied"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", owner: str = "source") -> DataFrame:
    """`docs` with every live-looking secret replaced by `mark`; widely copied examples stay. All rows and columns are kept.

    A value is live-looking or not for the whole corpus, so what `scan` found is decided by row and start; rows without a
    live-looking secret pass unchanged, and only the others are joined with their spans. Null and repeated doc_ids are no
    different: rows are told apart by a key of their own.
    """
    rows = keyed(docs, "_row")
    own = rows.select(F.col("_row").alias("doc_id"), F.col("doc_id").alias("_repo"), "text", F.col(owner).alias("_owner"))
    spans = scan(own, "_owner", "_repo").select(F.col("doc_id").alias("_row"), F.filter("all", lambda x: x["live"]).alias("_live")).where(F.size("_live") > 0)
    spans = materialize(spans, "live")
    clean = rows.join(spans.select("_row"), "_row", "left_anti").select(docs.columns)
    hit = rows.join(spans, "_row")

    cut = F.expr(
        "aggregate(_live, named_struct('at', 0L, 'out', ''), (acc, x) -> named_struct('at', greatest(acc.at, x.end), 'out', "
        f"concat(acc.out, if(x.start >= acc.at, concat(substring(text, int(acc.at) + 1, int(x.start - acc.at)), '{mark}'), ''))), "
        "acc -> concat(acc.out, substring(text, int(acc.at) + 1)))"
    )
    return clean.unionByName(hit.withColumn("text", cut).select(docs.columns))
