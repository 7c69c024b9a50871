"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Three rules give the base spans: assign (a keyword, a colon or equals sign, a value of 12 characters or more), access (AKIA keys of 18
or more) and hex (runs of 16 or more). The pieces between matches and the matches give positions, as running sums of their lengths in
code points. Beside them, long runs of mixed letters and digits are candidates.

Every value is hashed, and for each hash the corpus tells how many repositories (source and lang) and how many owners (source) hold it.
A value that WIDE or more owners share is a widely copied example. One of fewer owners that stands in SPREAD or more repositories of
theirs, for each owner, is what they put everywhere (a project's number, a public key), for a credential belongs to one place or few. The
rest is live-looking. Candidates that no base span overlaps become spans of kind live if they are live-looking; base spans stay, and
n_live, n_copied and n_spread tell the three apart.

Spans name the whole match. Null text counts as empty. Null sources and langs count as an owner or repository of their own. Rows
that repeat a doc_id are scanned one by one, rows with a null doc_id too. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .decontaminate import once

KINDS = ("assign", "access", "hex", "live")
# The rules. Runs are maximal, so a least length within a rule drops what a check after the match would drop; the
# value of an assignment is checked after it, for a short one must use up its text.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIXED = r"[A-Za-z0-9+/_-]{20,}"
RULES = (ASSIGN, ACCESS, HEX, MIXED)
GROUPS = (2, 0, 0, 0)
LEAST = 12
#: Owners from which on a value counts as widely copied, and repositories of each owner from which on it counts as put everywhere.
WIDE, SPREAD = 3, 3
LIVE, COPIED, EVERYWHERE = range(3)
#: Elements whose lengths are summed one by one; sums over whole blocks of them come from the block's start.
BLOCK = 64


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _sums(lengths: str) -> str:
    """The sum of each block of an array of lengths: running sums then take BLOCK steps an element at most, however many there are."""
    return f"transform(sequence(0, (size({lengths}) - 1) div {BLOCK}), b -> aggregate(slice({lengths}, b * {BLOCK} + 1, {BLOCK}), 0L, (a, x) -> a + x))"


def spans(documents: DataFrame) -> DataFrame:
    """rid, doc_id, owner, repository and found: array of (start, kind, end, hash) in order, of every row. One scan, no shuffle."""
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("owner"), F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("repository"))
    parts = []
    for k, (rule, group) in enumerate(zip(RULES, GROUPS, strict=True)):
        p = _quoted(rule)
        told = f"struct(transform(regexp_extract_all(text, '{p}', 0), m -> length(m)) AS m, transform(regexp_extract_all(text, '{p}', {group}), v -> if(length(v) >= {LEAST}, md5(v), NULL)) AS h, transform(split(text, '{p}', -1), g -> length(g)) AS g"
        mixed = f", transform(regexp_extract_all(text, '{p}', 0), v -> v RLIKE '[a-z]' AND v RLIKE '[A-Z]' AND v RLIKE '[0-9]') AS ok)" if k == 3 else ", CAST(NULL AS array<boolean>) AS ok)"
        parts.append(f"CASE WHEN text RLIKE '{p}' THEN {told}{mixed} END")
    # the texts end here; what follows are lengths and hashes
    raw = once(text, "r", F.array(*map(F.expr, parts)), "doc_id", "owner", "repository")
    step = raw.select("doc_id", "owner", "repository", *(F.expr(f"CASE WHEN r[{k}] IS NOT NULL THEN zip_with(slice(r[{k}].g, 1, size(r[{k}].m)), r[{k}].m, (g, m) -> g + m) END").alias(f"l{k}") for k in range(4)), "r")
    step = step.withColumn("sums", F.expr("array(" + ", ".join(f"CASE WHEN l{k} IS NOT NULL THEN {_sums(f'l{k}')} END" for k in range(4)) + ")"))
    step = once(step, "s", F.struct("r", *(f"l{k}" for k in range(4)), "sums"), "doc_id", "owner", "repository")
    bases = once(step, "b", F.expr("transform(s.sums, z -> CASE WHEN z IS NOT NULL THEN transform(sequence(0, size(z) - 1), i -> aggregate(slice(z, 1, i), 0L, (a, x) -> a + x)) END)"), "doc_id", "owner", "repository", "s")

    def placed(k: int) -> str:
        # a match starts after all earlier pieces and matches and its own piece, and ends with the sum
        end = f"b[{k}][i div {BLOCK}] + aggregate(slice(s.l{k}, (i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK} + 1), 0L, (a, x) -> a + x)"
        one = f"transform(sequence(0, size(s.l{k}) - 1), i -> struct({end} - s.r[{k}].m[i] AS start, {k} AS kind, {end} AS end, s.r[{k}].h[i] AS hash, {'s.r[3].ok[i]' if k == 3 else 'true'} AS ok))"
        return f"CASE WHEN s.l{k} IS NULL THEN CAST(array() AS array<struct<start:bigint,kind:int,end:bigint,hash:string,ok:boolean>>) ELSE filter({one}, x -> x.ok AND x.hash IS NOT NULL) END"

    found = once(bases, "found", F.struct(F.expr(f"array_sort(concat({placed(0)}, {placed(1)}, {placed(2)}))").alias("base"), F.expr(placed(3)).alias("more")), "doc_id", "owner", "repository")
    return found.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        "owner",
        "repository",
        F.col("found.base").alias("base"),
        F.expr("filter(found.more, c -> NOT exists(found.base, b -> b.start < c.end AND c.start < b.end))").alias("more"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_rows, n_repositories, n_owners of every value. Counted by owner and repository first, so a hash that is everywhere is a few rows of each task."""
    each = found.select("owner", "repository", F.explode(F.concat("base", "more")).alias("x")).select("owner", "repository", "x.hash")
    by_repository = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.sum("r").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


_JOINED = "array_join(transform({0}, x -> concat_ws(':', element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.kind + 1), x.start, x.end)), ',')"


def secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_spread of every row."""
    found = cut(spans(documents), "spans")
    owners = cut(ownership(found), "owners")
    each = found.select("rid", F.explode(F.concat("base", "more")).alias("x")).select("rid", "x.*")
    what = F.when(F.col("n_owners") >= WIDE, COPIED).when(F.col("n_repositories") >= SPREAD * F.col("n_owners"), EVERYWHERE).otherwise(LIVE)
    known = each.join(owners.select("hash", what.alias("what")), "hash").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "what"))).alias("known"))
    some = found.where("size(base) + size(more) > 0").join(known, "rid").select("doc_id", "base", "known")
    none = found.where("size(base) + size(more) = 0").select("doc_id", "base", F.expr("CAST(array() AS array<struct<start:bigint,kind:int,end:bigint,what:int>>)").alias("known"))
    count = lambda some: F.expr(f"CAST(size({some}) AS BIGINT)")
    return some.unionByName(none).select(
        "doc_id",
        *(count(f"filter(base, x -> x.kind = {k})").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])),
        F.sha2(F.expr(_JOINED.format("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_JOINED.format(f"filter(known, x -> x.kind < 3 OR x.what = {LIVE})")).alias("spans"),
        count(f"filter(known, x -> x.what = {LIVE})").alias("n_live"),
        count(f"filter(known, x -> x.what = {COPIED} AND x.kind < 3)").alias("n_copied"),
        count(f"filter(known, x -> x.what = {EVERYWHERE} AND x.kind < 3)").alias("n_spread"),
    )


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return secrets(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda p: p.replace("'", "''")
    one = " UNION ALL ".join(
        f"""SELECT rid, {k} AS kind, unnest(generate_series(1, len(string_split_regex(t, '{quote(p)}')))) AS i, unnest(regexp_extract_all(t, '{quote(p)}', 0)) AS m, unnest(regexp_extract_all(t, '{quote(p)}', {g})) AS v, unnest(string_split_regex(t, '{quote(p)}')) AS gap FROM d"""
        for k, (p, g) in enumerate(zip(RULES, GROUPS, strict=True))
    )
    names = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS)) + " END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents),
one AS ({one}),
placed AS (SELECT rid, kind, m, v, sum(length(gap) + coalesce(length(m), 0)) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM one),
matched AS (SELECT rid, kind, v, (stop - length(m))::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE m IS NOT NULL AND length(v) >= {LEAST}
  AND (kind < 3 OR regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]'))),
base AS (SELECT * FROM matched WHERE kind < 3),
found AS (SELECT * FROM base UNION ALL SELECT * FROM matched c WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.start < c.stop AND c.start < b.stop)),
owners AS (SELECT v, CASE WHEN count(DISTINCT owner) >= {WIDE} THEN {COPIED} WHEN count(DISTINCT repository) >= {SPREAD} * count(DISTINCT owner) THEN {EVERYWHERE} ELSE {LIVE} END AS what FROM found JOIN d USING (rid) GROUP BY v),
told AS (SELECT rid, kind, start, stop, what, {names} || ':' || start || ':' || stop AS span FROM found JOIN owners USING (v)),
row_ AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3 OR what = {LIVE}) AS spans,
  count(*) FILTER (what = {LIVE}) AS n_live, count(*) FILTER (what = {COPIED} AND kind < 3) AS n_copied, count(*) FILTER (what = {EVERYWHERE} AND kind < 3) AS n_spread FROM told GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(n_spread, 0) AS n_spread
FROM d LEFT JOIN row_ USING (rid)
"""


ORACLE = _oracle()
