"""SQL, for DuckDB, of the queries that SQL can express, over the same tables."""

from __future__ import annotations

from tallyfold.llm import mixing, sharding, warc

_FINITE = (
    "vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 "
    "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
)


def exact_top_k(k: int, every: int) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_FINITE}
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}"""


def _base32(hex_digest: str) -> str:
    letters = []
    for i in range(8):
        digits = [f"(strpos('0123456789abcdef', substr({hex_digest}, {5 * i + j + 1}, 1)) - 1) * {16 ** (4 - j)}" for j in range(5)]
        number = "(" + " + ".join(digits) + ")"
        letters += [f"substr('{warc.BASE32}', {number} // {1 << s} % 32 + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(letters)


def captures() -> str:
    """URL keys here are those of URLs with a scheme and a host."""
    return f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, url, sha1(coalesce(html, '')) AS hex,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest,
    regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query
  FROM pages
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_base32("hex")} AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to,
  lower(array_to_string(list_reverse(string_split(regexp_replace(host, '^www[.]', ''), '.')), ',') || ')'
    || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END) AS url_key,
  strftime(TIMESTAMP '2020-01-01 00:00:00' + to_seconds(page_id % 1000000000), '%Y%m%d%H%M%S') AS captured_at
FROM p"""


def mixture(entropy: float, seed: int = 1) -> str:
    """The query of sources mixed to an entropy, with the least budget that goes through every source once."""
    block = f"{mixing.mixed_sql('coalesce(doc_id, 0)', str(seed))} % {mixing.BLOCKS}"
    block_order = mixing.mixed_sql("b", f"({seed} + epochs)")
    row_order = mixing.mixed_sql("coalesce(doc_id, 0)", f"({seed} + epochs)")
    power = "list_transform(shares, lambda p: exp(ln(p) * {e}))"
    logs = "list_transform(shares, lambda p: exp(ln(p) * {e}) * ln(p) * {e})"
    flat = f"ln(list_sum({power})) - list_sum({logs}) / list_sum({power}) >= {entropy} * ln(len(shares))"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens,
    coalesce('=' || source, '') AS s, {block} AS b FROM documents
), blocks AS (
  SELECT s, b, sum(n_tokens) AS in_block FROM d GROUP BY s, b
), totals AS (
  SELECT s, CAST(sum(in_block) AS BIGINT) AS tokens FROM blocks GROUP BY s
), packed AS (
  SELECT list(tokens / CAST(everything AS DOUBLE)) AS shares
  FROM (SELECT tokens, sum(tokens) OVER () AS everything FROM totals) AS t WHERE tokens > 0
), halved(step, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN met THEN middle ELSE low END, CASE WHEN met THEN high ELSE middle END
  FROM (SELECT step, low, high, (low + high) / 2 AS middle, {flat.format(e="((low + high) / 2)")} AS met FROM halved, packed)
  WHERE step < {mixing.HALVINGS}
), chosen AS (
  SELECT CASE WHEN {flat.format(e="CAST(1 AS DOUBLE)")} THEN CAST(1 AS DOUBLE) ELSE low END AS exponent
  FROM halved, packed WHERE step = {mixing.HALVINGS}
), weighed AS (
  SELECT s, tokens, power / sum(power) OVER () AS weight FROM (
    SELECT s, tokens, CASE WHEN tokens > 0 THEN exp(ln(tokens / CAST(sum(tokens) OVER () AS DOUBLE)) * exponent) ELSE 0 END AS power
    FROM totals, chosen) AS t
), budgets AS (
  SELECT s, tokens, weight, CAST(coalesce(floor(weight * max(CASE WHEN tokens > 0 THEN tokens / weight END) OVER ()
    * (1 + 1e-12) + 1e-6), 0) AS BIGINT) AS budget FROM weighed
), draws AS (
  SELECT s, weight, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs,
    CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM budgets
), plan AS (
  SELECT s, b, weight, epochs, in_block, greatest(rest - (sum(in_block) OVER (PARTITION BY s ORDER BY {block_order}, b
    ROWS UNBOUNDED PRECEDING) - in_block), 0) AS rest_here FROM blocks JOIN draws USING (s)
), placed AS (
  SELECT doc_id, source, n_tokens, weight, epochs, rest_here, in_block, coalesce(sum(n_tokens) OVER (PARTITION BY s, b
    ORDER BY {row_order}, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN plan USING (s, b)
)
SELECT doc_id, source, n_tokens, CAST(epochs + CASE WHEN rest_here > 0 AND (rest_here >= in_block OR before < rest_here)
  THEN 1 ELSE 0 END AS BIGINT) AS copies, round(weight, 9) AS weight FROM placed"""


def _crc32(data: str) -> str:
    """The CRC-32 of a list of byte values, as one reduction with a table of what a byte does."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (byte & 1) * 0xEDB88320
        table.append(byte)
    step = f"xor(c >> 8, CAST({table}[(xor(c, b) & 255) + 1] AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, b: {step}), 4294967295)"


def _feistel(rows: str, x: str, seed: int) -> str:
    """A query of rows (with n, a and b) whose image is that of x under one pass of the permutation."""
    kept = "doc_id, size, text_crc32, n, a, b"
    query = f"SELECT {kept}, {x} // b AS l, {x} % b AS r FROM {rows}"
    for i in range(len(sharding.ROUND_KEYS)):
        linear, square = sharding.round_sql("l" if i % 2 else "r", i, seed)
        halves = f"l, (r + {square}) % b AS r" if i % 2 else f"(l + {square}) % a AS l, r"
        query = f"SELECT {kept}, {halves} FROM (SELECT *, {linear} AS _tf_t FROM ({query}) AS t) AS t"
    return f"SELECT {kept}, l * b + r AS image FROM ({query}) AS t"


def shards(n: int = 8, seed: int = 1) -> str:
    """The query of sharded documents, for ids that aren't null."""
    digit = "strpos('0123456789ABCDEF', substr(pair, {at}, 1)) - 1"
    byte = f"CAST(({digit.format(at=1)}) * 16 + {digit.format(at=2)} AS BIGINT)"
    data = f"list_transform(regexp_extract_all(h, '..'), lambda pair: {byte})"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT doc_id, CAST(octet_length(encode(t)) + 1 AS BIGINT) AS size, CAST({_crc32(data)} AS BIGINT) AS text_crc32 FROM d
), numbered AS (
  SELECT *, count(*) OVER () AS n, CAST(ceil(sqrt(CAST(count(*) OVER () AS DOUBLE))) AS BIGINT) AS a,
    row_number() OVER (ORDER BY {sharding.bucket_sql("doc_id")}, doc_id, text_crc32, size) - 1 AS x FROM sized
), start AS (
  SELECT *, (n + a - 1) // a AS b FROM numbered
), walk AS (
  {_feistel("start", "x", seed)}
  UNION ALL
  {_feistel("(SELECT * FROM walk WHERE image >= n) AS t", "image", seed)}
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(image % {n} AS INTEGER) AS shard, image // {n} AS slot,
  CAST(NULL AS INTEGER) AS grown_shard FROM walk WHERE image < n"""
