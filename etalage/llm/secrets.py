"""Secret scan by corpus-wide ownership frequency, in DataFrame operations only.

Every text is searched for candidates: the three base kinds, which are always
reported, and wider kinds (vendor prefixes, private keys, other names, link
passwords, long tokens).  A candidate's value is hashed, and its hash is counted over
distinct owners and repositories of the whole corpus.  A value that many owners
carry is a copied example; one that few owners carry and that looks alive is a
credential.  Wider candidates are reported only if they are credentials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etalage.llm.common import written

# The kinds in the order they are listed, the patterns of their
# candidates, the group that holds the value, and the least length of that group.
BASE = ("assign", "access", "hex")
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
    "vendor": (r"(gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|AIza|eyJ)[A-Za-z0-9_.-]{16,}", 0, 20),
    "pem": (r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]+", 0, 64),
    "named": (
        r"""([Pp][Ww][Dd]|[Pp]assphrase|[Cc]redential|[Bb]earer|[Pp]rivate_?[Kk]ey|[Aa]ccess_?[Kk]ey)["']?(\x20*[:=]\x20*|\x20+)["']?([A-Za-z0-9+/_.=-]+)""",
        3,
        12,
    ),
    "link": (r"://[^\x20\x09-\x0D/@:]+:([^\x20\x09-\x0D/@:]+)@", 1, 8),
    "token": (r"[A-Za-z0-9+/_=-]{24,}", 0, 24),
}
#: Words of values that stand for a secret in an example.
PLACEHOLDER = r"(example|sample|changeme|placeholder|dummy|your|xxxx|redacted|0123456|1234567|abcdefg)"
#: A value of at least so many owners is a copied example.
COPIED_OWNERS = 3
#: A live-looking value has at least so many different characters.
LIVE_CHARACTERS = 8


def _candidates(text: Column, kind: int, pattern: str, group: int) -> Column:
    """All matches of one pattern: the code points before each since the last, its own, its value."""
    # runs of the pattern for hex are only worth listing where one is long enough
    listed = r"[0-9a-f]{32,}" if pattern == KINDS["hex"][0] else pattern
    whole = F.regexp_extract_all(text, F.lit(listed), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(listed), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, listed, -1), lambda gap: F.length(gap).cast("long"))
    met = F.zip_with(whole, value, lambda w, v: F.struct(F.length(w).cast("long").alias("size"), v.alias("value")))
    rows = F.zip_with(
        F.slice(gaps, 1, F.size(whole)),
        met,
        lambda gap, m: F.struct(F.lit(kind).alias("kind"), gap.alias("gap"), m["size"].alias("size"), m["value"].alias("value")),
    )
    return F.when(text.rlike(listed), F.transform(rows, lambda r, at: r.withField("at", at)))


def _looks_alive(value: Column, kind: Column) -> Column:
    """Varied characters with a digit and a letter (long tokens: in both cases), and no placeholder word."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    cased = (kind != list(KINDS).index("token")) | (value.rlike("[A-Z]") & value.rlike("[a-z]"))
    return varied & mixed & cased & ~F.lower(value).rlike(PLACEHOLDER)


def scan_candidates(docs: DataFrame, text: str, owner: list[str], repository: list[str]) -> DataFrame:
    """(_row, doc_id, owner, repository, found) of every row; texts stay behind."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.flatten(
        F.array_compact(F.array(*[_candidates(body, k, p, g) for k, (p, g, _) in enumerate(KINDS.values())]))
    )

    def named(columns: list[str]) -> Column:
        return F.md5(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])))

    return docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col("doc_id").alias("doc_id"),
        named(owner).alias("owner"),
        named(owner + repository).alias("repository"),
        found.alias("found"),
    )


def candidate_spans(scanned: DataFrame) -> DataFrame:
    """One row per candidate that is long enough: its span in code points, value hash and look."""
    order = Window.partitionBy("_row", "kind").orderBy("at")
    least = F.element_at(F.array(*[F.lit(n) for _, _, n in KINDS.values()]), F.col("kind") + 1)
    return (
        scanned.where(F.size("found") > 0)
        .select("_row", "owner", "repository", F.explode("found").alias("f"))
        .select("_row", "owner", "repository", "f.*")
        .repartition("_row")
        .withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order))
        .where(F.length("value") >= least)
        .select(
            "_row", "owner", "repository", "kind",
            (F.col("end") - F.col("size")).alias("start"), "end",
            F.unhex(F.md5("value")).alias("hash"),
            _looks_alive(F.col("value"), F.col("kind")).alias("alive"),
        )
    )


def ownership(spans: DataFrame) -> DataFrame:
    """Per value hash the distinct owners and repositories that carry it, and its occurrences.

    Counted in steps from (hash, owner, repository) upwards, so that a value of a third of
    all rows is combined before each shuffle and no set of owners is ever held.
    """
    return (
        spans.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
        .groupBy("hash").agg(
            F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("occurrences")
        )
    )


def classified_spans(spans: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """The spans with their value's ownership and its verdict: live, example or unsure."""
    verdict = (
        F.when((F.col("owners") >= copied_owners), F.lit("example"))
        .when(F.col("alive"), F.lit("live"))
        .otherwise(F.lit("unsure"))
    )
    return spans.join(ownership(spans), "hash").withColumn("verdict", verdict)


def _reported(spans: DataFrame) -> DataFrame:
    """Base spans, and wider ones that are live and share no character with a base span."""
    base = F.col("kind") < len(BASE)
    order = Window.partitionBy("_row").orderBy("start", "kind")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        spans.where(base | (F.col("verdict") == "live"))
        .withColumn("_left", F.max(F.when(base, F.col("end"))).over(before))
        .withColumn("_right", F.min(F.when(base, F.col("start"))).over(after))
        .where(
            base
            | (
                (F.coalesce("_left", F.lit(0)) <= F.col("start"))
                & (F.col("_right").isNull() | (F.col("_right") >= F.col("end")))
            )
        )
        .drop("_left", "_right")
    )


def secret_scan(
    docs: DataFrame,
    text: str = "text",
    owner: tuple[str, ...] = ("source",),
    repository: tuple[str, ...] = ("lang",),
    copied_owners: int = COPIED_OWNERS,
) -> DataFrame:
    """One row per row of ``docs`` with the secrets of its whole text.

    ``owner`` names the columns that tell owners apart, ``repository`` those that, with them, tell
    repositories apart; of documents that name neither, the source is the owner and its texts of one
    language are a repository.

    ``spans`` is an array of (kind, start, end, verdict, owners, repositories, occurrences) by start, then
    kind: base kinds always, wider kinds if live and clear of base spans.  Starts and ends are code
    points, the end exclusive.

    A null or empty text has no spans.  A null owner or repository counts as one, named ''.  Repeated
    rows stay rows of their own, also with one id, and count as further occurrences, not as further
    owners.  An empty table gives an empty result.  Other columns are ignored.  Rows are told apart by a number
    that is written with the candidates, so that a lost executor repeats nothing differently.
    """
    scanned = written(scan_candidates(docs, text, list(owner), list(repository)), "candidates")
    spans = written(candidate_spans(scanned), "spans")
    entry = F.struct(
        "start", F.col("kind").alias("k"), "end", "verdict", "owners", "repositories", "occurrences"
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    grouped = (
        _reported(classified_spans(spans, copied_owners))
        .groupBy("_row")
        .agg(F.sort_array(F.collect_list(entry)).alias("spans"))
        .withColumn(
            "spans",
            F.transform(
                "spans",
                lambda s: F.struct(
                    F.get(names, s["k"]).alias("kind"),
                    s["start"].alias("start"),
                    s["end"].alias("end"),
                    s["verdict"].alias("verdict"),
                    s["owners"].alias("owners"),
                    s["repositories"].alias("repositories"),
                    s["occurrences"].alias("occurrences"),
                ),
            ),
        )
    )
    kind = dict(grouped.dtypes)["spans"]
    bare = F.size("found") == 0
    return (
        scanned.where(~bare).join(grouped, "_row", "left")
        .select("doc_id", F.coalesce("spans", F.array().cast(kind)).alias("spans"))
        .union(scanned.where(bare).select("doc_id", F.array().cast(kind).alias("spans")))
    )


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, and all spans as text."""

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(field: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long").alias(f"n_{value}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [count("kind", kind) for kind in BASE]
    verdicts = [count("verdict", verdict) for verdict in ("live", "example")]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *verdicts
    )
