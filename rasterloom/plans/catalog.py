"""The engine's queries over the test tables, and SQL for the same results.

The embeddings table serves as a raster: a row for each vector, 64 bytes wide. Stacking it in y makes more than one chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bytes as B
from ..functions import spec as S
from ..operators import chunks as C
from ..operators import filters as R
from ..operators.deflate import deflate_chunks, inflate_chunks
from ..operators.framing import header_bytes
from ..sources.rasters import pixels, quantised, stacked
from .encode import encode, encode_frames, progress

STACK = 8
SMALL = S.EncodeOptions(chunk_size=S.WINDOW)
BLOCK = 1000
WIDTHS = (1, 2, 3, 4, 7, 8, 12, 15, 21, 64, 1920)
HEIGHTS, CHUNK_SIZES, STRIDES = (1, 45, 46, 47, 768, 1080), (32768, 200000, 262144), (1, 64, 3072, 5760, 789504)
LEVELS = ((1, None), (6, None), (9, None), (6, 0), (6, 2), (6, 3), (6, 4))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str, length: int = 64) -> DataFrame:
    return quantised(table(spark, sf_dir, "embeddings"), length=length)


def tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacked(raster(spark, sf_dir), STACK)


def height(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").count()


def grey(spark: SparkSession, sf_dir: str, times: int = 1) -> S.RasterSpec:
    return S.RasterSpec(64, times * height(spark, sf_dir), S.ColorType.GREYSCALE, 8)


def above(rows: DataFrame, length: int = 64, options: S.EncodeOptions | None = None) -> DataFrame:
    """Rows with the row over each, dealt by chunk."""
    return R.with_previous(rows, -(-(options or S.EncodeOptions()).chunk_size // (length + 1)))


def binary(rows: DataFrame) -> DataFrame:
    return rows.select("image_id", "y", B.to_bytes(F.col("src")).alias("row"))


def long(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(n).cast("long").alias(n) for n in names))


def values(spark: SparkSession, text: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({names})")


def _codes(spark: SparkSession) -> DataFrame:
    kinds = ", ".join(f"({int(k)})" for k in S.ColorType)
    depths = ", ".join(f"({d})" for d in (1, 2, 4, 8, 16))
    return values(spark, kinds, "color_type").crossJoin(values(spark, depths, "depth"))


def depth_validity(spark, sf_dir):
    return _codes(spark).select(F.col("color_type").cast("long").alias("color_type"), F.col("depth").cast("long").alias("depth"), S.depth_valid(F.col("color_type"), F.col("depth")).alias("valid"))


def spec_derived(spark, sf_dir):
    legal = _codes(spark).where(S.depth_valid(F.col("color_type"), F.col("depth"))).withColumn("width", F.explode(F.array(*map(F.lit, WIDTHS))))
    c, d, w = F.col("color_type"), F.col("depth"), F.col("width")
    return long(legal.select(c, d, w, S.channels(c).alias("channels"), S.bpp(c, d).alias("bpp"), S.stride(c, d, w).alias("stride")), "color_type", "depth", "width", "channels", "bpp", "stride")


def chunk_plan(spark, sf_dir):
    one = spark.range(1)
    for name, what in (("height", HEIGHTS), ("chunk_size", CHUNK_SIZES), ("stride", STRIDES)):
        one = one.withColumn(name, F.explode(F.array(*(F.lit(x).cast("long") for x in what))))
    one = one.withColumn("rpc", S.rows_per_chunk(F.col("chunk_size"), F.col("stride")))
    return one.select("height", "chunk_size", "stride", "rpc", S.chunks_total(F.col("height"), F.col("rpc")).alias("chunks_total"))


def chunk_ranges(spark, sf_dir):
    rows = tall(spark, sf_dir).groupBy("image_id").agg((F.max("y") + 1).alias("height")).withColumn("rows_per_chunk", F.lit(-(-S.WINDOW // 65)).cast("long"))
    return C.ranges(rows).drop("image_id")


def filter_query(kind: S.Filter, bpp: int, length: int, spark, sf_dir):
    rows = above(raster(spark, sf_dir, length), length)
    return long(pixels(rows.select("image_id", "y", R.filtered(kind, bpp).alias("src"))), "y", "x", "v")


def row_complexity(spark, sf_dir):
    return long(R.costs(above(raster(spark, sf_dir)), 1), "y", "c_sub", "c_up", "c_average", "c_paeth")


def adaptive_choice(spark, sf_dir):
    code, best = R.choice()
    return long(R.costs(above(raster(spark, sf_dir)), 1).select("y", code.alias("filter_type"), best.alias("complexity")), "y", "filter_type", "complexity")


def adaptive_rows(spark, sf_dir):
    rows = R.adaptive(above(raster(spark, sf_dir)), 1)
    return long(pixels(rows, "data").withColumn("x", F.col("x") - 1), "y", "x", "v")


def effective_mode(spark, sf_dir):
    one = values(spark, ", ".join(f"({int(k)})" for k in S.ColorType), "color_type")
    one = one.withColumn("filter", F.explode(F.expr("array(NULL, 0, 1, 2, 3, 4)"))).withColumn("strategy", F.explode(F.expr("array(NULL, 0, 1, 2, 3, 4)")))
    c, f, s = F.col("color_type"), F.col("filter"), F.col("strategy")
    shown = lambda x: F.coalesce(x, F.lit(-1))  # noqa: E731  (adaptive)
    return long(one.select(c, shown(f).alias("filter"), shown(s).alias("strategy"), shown(S.effective_filter(c, f)).alias("eff_filter"), S.effective_strategy(c, f, s).alias("eff_strategy")), "color_type", "filter", "strategy", "eff_filter", "eff_strategy")


def _payloads(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("data"))
    return d.unionByName(table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").cast("binary").alias("data")))


def byte_adler32(spark, sf_dir):
    return _payloads(spark, sf_dir).select("kind", "id", B.adler32("data").alias("adler"))


def chunk_adler_combine(spark, sf_dir):
    data = _payloads(spark, sf_dir).where("kind = 'document'")
    parts = data.select("id", "data", F.explode(F.expr(f"sequence(0, greatest(0, (octet_length(data) - 1) div {BLOCK}))")).alias("k"))
    parts = parts.select("id", "k", F.expr(f"substring(data, k * {BLOCK} + 1, {BLOCK})").alias("piece"))
    parts = parts.select("id", "k", F.octet_length("piece").cast("long").alias("n"), B.adler32("piece").alias("adler"))
    return parts.groupBy("id").agg(B.adler32_combine(F.collect_list(F.struct("k", "n", "adler"))).alias("combined"))


def byte_crc32(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


def frame_bytes(spark, sf_dir):
    data = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    return data.select("doc_id", F.octet_length("data").cast("long").alias("len"), F.lit("IDAT").alias("tag"), F.crc32(F.concat(F.lit(b"IDAT"), "data")).alias("crc"), F.lower(F.hex(B.frame(F.lit(b"IDAT"), F.col("data")))).alias("frame_hex"))


SPECS = ((1920, 1080, 8, 2), (1024, 768, 8, 2), (1, 1, 1, 0), (640, 480, 16, 6), (33, 5, 4, 3), (7, 9, 16, 4))


def signature_ihdr(spark, sf_dir):
    one = values(spark, ", ".join(map(str, SPECS)), "width, height, depth, color_type")
    return one.select(*(F.col(n).cast("long").alias(n) for n in one.columns), F.lower(F.hex(header_bytes(F.col("width"), F.col("height"), F.col("depth"), F.col("color_type")))).alias("header_hex"))


def prior_chunk_pairs(spark, sf_dir):
    rpc = -(-S.WINDOW // 65)
    rows = tall(spark, sf_dir)
    # a chunk's last row is the boundary of the next one
    each = rows.select("image_id", "y", F.floor(F.col("y") / rpc).alias("chunk_id"), F.aggregate("src", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))
    ends = each.groupBy("image_id", "chunk_id").agg(F.max_by("total", "y").alias("last_sum"))
    w = C.prior_pairs(ends)
    before = ends.select("image_id", (F.col("chunk_id") + 1).alias("chunk_id"), F.col("last_sum").alias("boundary_sum"))
    return long(w.join(before, ["image_id", "chunk_id"], "left").withColumn("boundary_sum", F.coalesce("boundary_sum", F.lit(0))).withColumn("prev_chunk_id", F.coalesce("prev_chunk_id", F.lit(-1))), "chunk_id", "prev_chunk_id", "boundary_sum")


def dictionary_trailer(spark, sf_dir):
    rpc = -(-S.WINDOW // 65)
    filtered = R.filter_rows(above(tall(spark, sf_dir), options=SMALL), 1, None)
    tails = C.trailers(C.filtered_chunks(filtered, rpc))
    tail = F.coalesce("tail", F.array().cast("array<int>"))
    return tails.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.size(tail).cast("long").alias("tail_len"), B.adler32_of_ints(tail).alias("tail_adler"))


def deflate_roundtrip(spark, sf_dir):
    rows, spec, out = binary(tall(spark, sf_dir)), grey(spark, sf_dir, STACK), None
    for level, strategy in LEVELS:
        options = S.EncodeOptions(S.WINDOW, level, strategy)
        got = inflate_chunks(deflate_chunks(rows, spec, options, keep_dictionary=True)).select(F.lit(level).cast("long").alias("level"), F.lit(-1 if strategy is None else strategy).cast("long").alias("strategy"), "chunk_id", "inflated_len", "inflated_adler")
        out = got if out is None else out.unionByName(got)
    return out


def layout(streaming: bool, spark, sf_dir):
    rows, spec = binary(tall(spark, sf_dir)), grey(spark, sf_dir, STACK)
    return encode_frames(rows, spec, S.EncodeOptions(S.WINDOW, streaming=streaming)).select("ordinal", "tag")


CASES = tuple((c, p, n) for c in (0, 2, 3, 4, 6) for p in (None, 2, 3, 4, 6, 768) for n in (0, 1, 2, 3, 6))


def palette_trns_rules(spark, sf_dir):
    text = ", ".join(f"({c}, {'CAST(NULL AS INT)' if p is None else p}, {n})" for c, p, n in CASES)
    one = values(spark, text, "color_type, palette_bytes, trns_bytes")
    c, p, n = F.col("color_type"), F.col("palette_bytes"), F.col("trns_bytes")
    good = F.coalesce(S.palette_accepted(p, F.lit(False)), F.lit(False))
    trns = S.transparency_accepted(c, n, F.when(good, p))
    return one.select(c.cast("long").alias("color_type"), F.coalesce(p, F.lit(-1)).cast("long").alias("palette_bytes"), n.cast("long").alias("trns_bytes"), good.alias("palette_accepted"), trns.alias("trns_accepted"))


def progress_query(spark, sf_dir):
    spec = grey(spark, sf_dir, STACK)
    return progress(deflate_chunks(binary(tall(spark, sf_dir)), spec, SMALL), spec, SMALL).drop("image_id")


def encode_png(spark, sf_dir):
    """Encodes the raster, decodes the files again and gives the checksum of every row."""
    from ..operators.deflate import decode_files

    png = encode(binary(raster(spark, sf_dir)), grey(spark, sf_dir))
    return decode_files(png).select("y", B.adler32("row").alias("row_adler"))


def stream_encode(spark, sf_dir):
    """The raster's table as a stream of rows; what the stream wrote, in order."""
    import uuid

    from ..session import shared_dir
    from ..streaming.encode import encode_stream

    spec = grey(spark, sf_dir)
    schema = table(spark, sf_dir, "embeddings").schema
    # a pattern, for a plain path would have to be a folder
    vectors = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parque[t]")
    base = f"{shared_dir(spark)}/rasterloom/stream-{uuid.uuid4().hex}"
    out = encode_stream(binary(quantised(vectors)), spec, S.EncodeOptions(S.WINDOW, streaming=True))
    out.writeStream.format("parquet").option("path", f"{base}/frames").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/frames").select("ordinal", "tag")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "depth_validity": depth_validity,
    "spec_derived": spec_derived,
    "chunk_plan": chunk_plan,
    "chunk_ranges": chunk_ranges,
    "filter_none": partial(filter_query, S.Filter.NONE, 1, 64),
    "filter_sub": partial(filter_query, S.Filter.SUB, 1, 64),
    "filter_up": partial(filter_query, S.Filter.UP, 1, 64),
    "filter_average": partial(filter_query, S.Filter.AVERAGE, 1, 64),
    "filter_paeth": partial(filter_query, S.Filter.PAETH, 1, 64),
    "filter_sub_bpp4": partial(filter_query, S.Filter.SUB, 4, 64),
    "filter_average_bpp3": partial(filter_query, S.Filter.AVERAGE, 3, 64),
    "filter_paeth_bpp8": partial(filter_query, S.Filter.PAETH, 8, 64),
    "row_complexity": row_complexity,
    "adaptive_choice": adaptive_choice,
    "adaptive_rows": adaptive_rows,
    "effective_mode": effective_mode,
    "byte_adler32": byte_adler32,
    "chunk_adler_combine": chunk_adler_combine,
    "byte_crc32": byte_crc32,
    "frame_bytes": frame_bytes,
    "signature_ihdr": signature_ihdr,
    "prior_chunk_pairs": prior_chunk_pairs,
    "dictionary_trailer": dictionary_trailer,
    "deflate_roundtrip": deflate_roundtrip,
    "frame_layout_buffered": partial(layout, False),
    "frame_layout_streaming": partial(layout, True),
    "palette_trns_rules": palette_trns_rules,
    "progress": progress_query,
    "encode_png": encode_png,
    "stream_encode": stream_encode,
}

# --- the same results in SQL -------------------------------------------------------------------------------------------------


def _px(length: int = 64, times: int = 1) -> str:
    once = f"""SELECT vec_id AS y, x, greatest(0, least(255, floor((e::DOUBLE + 1.0) * 128)))::BIGINT AS v
      FROM (SELECT vec_id, unnest(generate_series(0, len(embedding) - 1)) AS x, unnest(embedding) AS e FROM embeddings) WHERE x < {length}"""
    if times == 1:
        return f"px AS ({once})"
    return f"px1 AS ({once}), px AS (SELECT y + k * (SELECT count(*) FROM embeddings) AS y, x, v FROM px1, range({times}) AS t(k))"


def _near(bpp: int) -> str:
    return f"""n1 AS (SELECT *, coalesce(lag(v, {bpp}) OVER (PARTITION BY y ORDER BY x), 0) AS l, coalesce(lag(v) OVER (PARTITION BY x ORDER BY y), 0) AS u FROM px),
    near AS (SELECT *, coalesce(lag(u, {bpp}) OVER (PARTITION BY y ORDER BY x), 0) AS c FROM n1)"""


_FORMULA = {
    0: "v",
    1: "(v - l + 256) % 256",
    2: "(v - u + 256) % 256",
    3: "(v - (l + u) // 2 + 256) % 256",
    4: "(v - CASE WHEN abs(u - c) <= abs(l - c) AND abs(u - c) <= abs(l + u - 2 * c) THEN l WHEN abs(l - c) <= abs(l + u - 2 * c) THEN u ELSE c END + 256) % 256",
}


def _filter_sql(kind: int, bpp: int, length: int) -> str:
    return f"WITH {_px(length)}, {_near(bpp)} SELECT y, x, ({_FORMULA[kind]})::BIGINT AS v FROM near"


_CHOICE = f"""f AS (SELECT y, x, {', '.join(f'{_FORMULA[k]} AS f{k}' for k in range(1, 5))} FROM near),
  cost AS (SELECT y, {', '.join(f'sum(least(f{k}, 256 - f{k}))::BIGINT AS c{k}' for k in range(1, 5))} FROM f GROUP BY y),
  best AS (SELECT *, least(c1, c2, c3, c4) AS m, CASE WHEN c1 = least(c1, c2, c3, c4) THEN 1 WHEN c2 = least(c1, c2, c3, c4) THEN 2 WHEN c3 = least(c1, c2, c3, c4) THEN 3 ELSE 4 END AS code FROM cost),
  rows_ AS (SELECT y, x, CASE code WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 ELSE f4 END AS v FROM f JOIN best USING (y) UNION ALL SELECT y, -1, code FROM best)"""
_RPC = -(-S.WINDOW // 65)
_BYTES = "list_transform(list_filter(string_split_regex(regexp_replace(hex(encode({0})), '(..)', '\\1,', 'g'), ','), lambda s: s <> ''), lambda s: ('0x' || s)::INT)"
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n))"


def _adler_sql(key: str, source: str) -> str:
    """One row for each key of source(key, d), d being a list of bytes."""
    return f"""SELECT {key}, ((n + coalesce(list_sum(list_transform(generate_series(1, n), lambda i: (n - i + 1) * d[i])), 0)) % 65521 * 65536 + (1 + coalesce(list_sum(d), 0)) % 65521)::BIGINT"""


def _chunked(total: str) -> str:
    return f"(({total} + {_RPC} - 1) // {_RPC})"


_TALL = f"({STACK} * (SELECT count(*) FROM embeddings))"
_DEPTH = " OR ".join(f"color_type = {k} AND depth IN ({', '.join(map(str, d))})" for k, d in S.DEPTHS.items())
_CHANNELS = "CASE color_type " + " ".join(f"WHEN {k} THEN {n}" for k, n in S.CHANNELS.items()) + " END"
_CODES_SQL = "codes AS (SELECT color_type, depth FROM (VALUES (0), (2), (3), (4), (6)) a(color_type), (VALUES (1), (2), (4), (8), (16)) b(depth))"


def _list(xs) -> str:
    return "[" + ", ".join("NULL" if x is None else str(x) for x in xs) + "]"


_CRC_OF = "xor(list_reduce({d}, lambda acc, v: xor(acc >> 8, tbl[(xor(acc, v) & 255) + 1]), 4294967295), 4294967295)"

ORACLES: dict[str, str] = {
    "depth_validity": f"WITH {_CODES_SQL} SELECT color_type::BIGINT AS color_type, depth::BIGINT AS depth, ({_DEPTH}) AS valid FROM codes",
    "spec_derived": f"""WITH {_CODES_SQL}, legal AS (SELECT *, unnest({_list(WIDTHS)}) AS width, {_CHANNELS} AS channels FROM codes WHERE {_DEPTH})
      SELECT color_type::BIGINT AS color_type, depth::BIGINT AS depth, width::BIGINT AS width, channels::BIGINT AS channels, (channels * CASE WHEN depth > 8 THEN 2 ELSE 1 END)::BIGINT AS bpp,
      ceil(channels * depth * width / 8.0)::BIGINT AS stride FROM legal""",
    "chunk_plan": f"""WITH p AS (SELECT * FROM (SELECT unnest({_list(HEIGHTS)})::BIGINT AS height), (SELECT unnest({_list(CHUNK_SIZES)})::BIGINT AS chunk_size), (SELECT unnest({_list(STRIDES)})::BIGINT AS stride)),
      q AS (SELECT *, ceil(chunk_size / (stride + 1.0))::BIGINT AS rpc FROM p) SELECT *, ceil(height / rpc::DOUBLE)::BIGINT AS chunks_total FROM q""",
    "chunk_ranges": f"""SELECT i::BIGINT AS chunk_id, (i * {_RPC})::BIGINT AS start_row, least((i + 1) * {_RPC}, {_TALL})::BIGINT AS end_row, i = 0 AS is_start, i = {_chunked(_TALL)} - 1 AS is_end
      FROM (SELECT unnest(range({_chunked(_TALL)}::BIGINT)) AS i)""",
    "filter_none": _filter_sql(0, 1, 64),
    "filter_sub": _filter_sql(1, 1, 64),
    "filter_up": _filter_sql(2, 1, 64),
    "filter_average": _filter_sql(3, 1, 64),
    "filter_paeth": _filter_sql(4, 1, 64),
    "filter_sub_bpp4": _filter_sql(1, 4, 64),
    "filter_average_bpp3": _filter_sql(3, 3, 64),
    "filter_paeth_bpp8": _filter_sql(4, 8, 64),
    "row_complexity": f"WITH {_px()}, {_near(1)}, {_CHOICE} SELECT y, c1 AS c_sub, c2 AS c_up, c3 AS c_average, c4 AS c_paeth FROM cost",
    "adaptive_choice": f"WITH {_px()}, {_near(1)}, {_CHOICE} SELECT y, code::BIGINT AS filter_type, m AS complexity FROM best",
    "adaptive_rows": f"WITH {_px()}, {_near(1)}, {_CHOICE} SELECT y, x::BIGINT AS x, v::BIGINT AS v FROM rows_",
    "effective_mode": """WITH m AS (SELECT * FROM (VALUES (0), (2), (3), (4), (6)) a(color_type), (VALUES (NULL), (0), (1), (2), (3), (4)) b(filter), (VALUES (NULL), (0), (1), (2), (3), (4)) c(strategy)),
      e AS (SELECT *, CASE WHEN filter IS NULL AND color_type = 3 THEN 0 ELSE filter END AS eff_filter FROM m)
      SELECT color_type::BIGINT AS color_type, coalesce(filter, -1)::BIGINT AS filter, coalesce(strategy, -1)::BIGINT AS strategy, coalesce(eff_filter, -1)::BIGINT AS eff_filter, coalesce(strategy, CASE WHEN eff_filter = 0 THEN 0 ELSE 1 END)::BIGINT AS eff_strategy FROM e""",
    "byte_adler32": f"""WITH p AS (SELECT 'document' AS kind, doc_id AS id, {_BYTES.format('text')} AS d FROM documents UNION ALL SELECT 'page', page_id, {_BYTES.format('html')} FROM pages), q AS (SELECT *, len(d)::BIGINT AS n FROM p)
      {_adler_sql('kind, id', 'q')} AS adler FROM q""",
    "chunk_adler_combine": f"WITH q AS (SELECT doc_id AS id, {_BYTES.format('text')} AS d, octet_length(encode(text))::BIGINT AS n FROM documents) {_adler_sql('id', 'q')} AS combined FROM q",
    "byte_crc32": f"WITH q AS (SELECT doc_id, list_transform({_BYTES.format('text')}, lambda x: x::BIGINT) AS d, {_CRC_TABLE} AS tbl FROM documents) SELECT doc_id, {_CRC_OF.format(d='d')}::BIGINT AS crc FROM q",
    "frame_bytes": f"""WITH q AS (SELECT doc_id, text, list_concat([73, 68, 65, 84]::BIGINT[], list_transform({_BYTES.format('text')}, lambda x: x::BIGINT)) AS d, {_CRC_TABLE} AS tbl FROM documents),
      r AS (SELECT doc_id, text, len(d)::BIGINT - 4 AS len, {_CRC_OF.format(d='d')}::BIGINT AS crc FROM q)
      SELECT doc_id, len, 'IDAT' AS tag, crc, lower(printf('%08x', len) || '49444154' || hex(encode(text)) || printf('%08x', crc)) AS frame_hex FROM r""",
    "signature_ihdr": f"""WITH s AS (SELECT * FROM (VALUES {', '.join(map(str, SPECS))}) t(width, height, depth, color_type)),
      b AS (SELECT *, '49484452' || printf('%08x', width) || printf('%08x', height) || printf('%02x', depth) || printf('%02x', color_type) || '000000' AS body FROM s),
      q AS (SELECT *, list_transform(range(len(body) // 2), lambda i: ('0x' || body[2 * i + 1:2 * i + 2])::BIGINT) AS d, {_CRC_TABLE} AS tbl FROM b)
      SELECT width::BIGINT AS width, height::BIGINT AS height, depth::BIGINT AS depth, color_type::BIGINT AS color_type, '89504e470d0a1a0a0000000d' || body || printf('%08x', {_CRC_OF.format(d='d')}::BIGINT) AS header_hex FROM q""",
    "prior_chunk_pairs": f"""WITH {_px(64, STACK)}, r AS (SELECT y, sum(v)::BIGINT AS total FROM px GROUP BY y), c AS (SELECT DISTINCT y // {_RPC} AS chunk_id FROM r)
      SELECT chunk_id::BIGINT AS chunk_id, coalesce(lag(chunk_id) OVER (ORDER BY chunk_id), -1)::BIGINT AS prev_chunk_id, coalesce((SELECT total FROM r WHERE r.y = c.chunk_id * {_RPC} - 1), 0)::BIGINT AS boundary_sum FROM c""",
    "dictionary_trailer": f"""WITH {_px(64, STACK)}, {_near(1)}, {_CHOICE},
      b AS (SELECT y // {_RPC} AS k, v, row_number() OVER (PARTITION BY y // {_RPC} ORDER BY y DESC, x DESC) AS back FROM rows_),
      t AS (SELECT k + 1 AS chunk_id, count(*) AS n, sum(v) AS a, sum(back * v) AS w FROM b WHERE back <= {S.WINDOW} GROUP BY k),
      c AS (SELECT DISTINCT y // {_RPC} AS chunk_id FROM px)
      SELECT chunk_id::BIGINT AS chunk_id, coalesce(n, 0)::BIGINT AS tail_len, (coalesce((n + w) % 65521, 0) * 65536 + (1 + coalesce(a, 0)) % 65521)::BIGINT AS tail_adler FROM c LEFT JOIN t USING (chunk_id)""",
    "deflate_roundtrip": f"""WITH {_px(64, STACK)}, {_near(1)}, {_CHOICE},
      b AS (SELECT y // {_RPC} AS chunk_id, v, row_number() OVER (PARTITION BY y // {_RPC} ORDER BY y DESC, x DESC) AS back FROM rows_),
      t AS (SELECT chunk_id, count(*) AS n, sum(v) AS a, sum(back * v) AS w FROM b GROUP BY chunk_id)
      SELECT level::BIGINT AS level, strategy::BIGINT AS strategy, chunk_id::BIGINT AS chunk_id, n::BIGINT AS inflated_len, ((n + w) % 65521 * 65536 + (1 + a) % 65521)::BIGINT AS inflated_adler
      FROM t, (VALUES {', '.join(f'({a}, {-1 if b is None else b})' for a, b in LEVELS)}) o(level, strategy)""",
    "frame_layout_buffered": "SELECT * FROM (VALUES (0::BIGINT, 'IHDR'), (1, 'IDAT'), (2, 'IEND')) t(ordinal, tag)",
    "frame_layout_streaming": f"SELECT i::BIGINT AS ordinal, CASE WHEN i = 0 THEN 'IHDR' WHEN i = {_chunked(_TALL)} + 2 THEN 'IEND' ELSE 'IDAT' END AS tag FROM (SELECT unnest(range({_chunked(_TALL)}::BIGINT + 3)) AS i)",
    "palette_trns_rules": f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"({a}, {'NULL' if b is None else b}, {n})" for a, b, n in CASES)}) t(color_type, palette_bytes, trns_bytes)),
      g AS (SELECT *, coalesce(palette_bytes >= 3 AND palette_bytes % 3 = 0, false) AS ok FROM c)
      SELECT color_type::BIGINT AS color_type, coalesce(palette_bytes, -1)::BIGINT AS palette_bytes, trns_bytes::BIGINT AS trns_bytes, ok AS palette_accepted,
      CASE color_type WHEN 0 THEN trns_bytes = 2 WHEN 2 THEN trns_bytes = 6 WHEN 3 THEN ok AND trns_bytes > 0 AND trns_bytes <= palette_bytes // 3 ELSE false END AS trns_accepted FROM g""",
    "progress": f"SELECT {_chunked(_TALL)}::BIGINT AS chunks_output, {_chunked(_TALL)}::BIGINT AS chunks_total, 1.0::DOUBLE AS fraction",
    "encode_png": f"WITH {_px()}, t AS (SELECT y, count(*) AS n, sum(v) AS a, sum((64 - x) * v) AS w FROM px GROUP BY y) SELECT y, ((n + w) % 65521 * 65536 + (1 + a) % 65521)::BIGINT AS row_adler FROM t",
    "stream_encode": f"SELECT i::BIGINT AS ordinal, CASE WHEN i = 0 THEN 'IHDR' WHEN i = c + 2 THEN 'IEND' ELSE 'IDAT' END AS tag FROM (SELECT c, unnest(range(c + 3)) AS i FROM (SELECT ((count(*) + {_RPC} - 1) // {_RPC})::BIGINT AS c FROM embeddings))",
}
