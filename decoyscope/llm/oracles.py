"""DuckDB SQL for the operators that SQL can express."""

from . import backoff, mixing, secret_scan, sharding, spelling

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DECONTAMINATION = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS width, array_to_string(w[k : k + 9], ' ') AS phrase
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0
), widths AS (SELECT DISTINCT width FROM windows), places AS (
  SELECT row_id, width, k, array_to_string(w[k : k + width - 1], ' ') AS phrase
  FROM d, widths, unnest(range(1, len(w) - width + 2)) AS t(k)
), hits AS (SELECT row_id, k, width, item FROM places JOIN windows USING (width, phrase)), words AS (
  SELECT row_id, count(DISTINCT k + j) AS n_hit FROM hits, unnest(range(0, width)) AS t(j) GROUP BY row_id
), items AS (
  SELECT row_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS named FROM hits GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row_id) LEFT JOIN items USING (row_id)"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINES = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), l AS (
  SELECT row_id, doc_id, n, lines[n] AS line,
    translate(trim(lines[n], {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(range(1, len(lines) + 1)) AS t(n)
), owners AS (SELECT key, min(coalesce(doc_id, 9223372036854775807)) AS owner FROM l WHERE length(key) >= 10 GROUP BY key), judged AS (
  SELECT row_id, n, line, owner IS NOT NULL AND owner <> coalesce(doc_id, 9223372036854775807) AS gone FROM l LEFT JOIN owners USING (key)
), kept AS (
  SELECT row_id, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone) AS text FROM judged GROUP BY row_id
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256
FROM d JOIN kept USING (row_id)"""



def _secrets() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    kinds = []
    for order, (kind, (pattern, group)) in enumerate(secret_scan._PATTERNS.items(), 1):
        kinds.append(
            f"SELECT row_id, doc_id, owner, '{kind}' AS kind, {order} AS ord, string_split_regex(text, {quoted(pattern)}) AS pieces, "
            f"regexp_extract_all(text, {quoted(pattern)}) AS whole, regexp_extract_all(text, {quoted(pattern)}, {group}) AS vals FROM d"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, source AS owner, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(kinds)}), p AS (
  SELECT row_id, doc_id, owner, kind, ord, whole[k] AS whole, vals[k] AS val,
    list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:k-1], lambda x: length(x))), 0) AS start
  FROM m, unnest(range(1, len(whole) + 1)) AS t(k)
), c AS (
  SELECT *, start + length(whole) AS stop FROM p WHERE (kind <> 'assign' OR length(val) >= {secret_scan.MIN_ASSIGNED}) AND (kind <> 'owned' OR
    (regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]')))
), o AS (
  SELECT val, n_owners > {secret_scan.MAX_OWNERS} OR n_owners > 1 AND n_repositories > {secret_scan.MAX_REPOSITORIES} AS copied FROM (
    SELECT val, count(DISTINCT owner) + CAST(bool_or(owner IS NULL) AS INTEGER) AS n_owners, count(DISTINCT doc_id) AS n_repositories FROM c GROUP BY val)
), j AS (
  SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM c JOIN o USING (val) WHERE kind <> 'owned' OR NOT copied
), s AS (
  SELECT row_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, ord) FILTER (kind <> 'owned') AS base, string_agg(span, ',' ORDER BY start, ord) AS spans,
    count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied FROM j GROUP BY row_id
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live,
  CAST(coalesce(n_copied, 0) AS BIGINT) AS n_copied
FROM d LEFT JOIN s USING (row_id)"""



_BITS = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT)"

_SHARDS = f"""
WITH k AS (SELECT row_number() OVER () AS row_id, doc_id, {_BITS} AS bits, strlen(coalesce(text, '')) AS bytes FROM documents),
p AS (SELECT row_id, depth, bits >> ({sharding.BITS} - depth) AS prefix, bits, bytes FROM k, unnest(range(0, {sharding.BITS + 1})) AS t(depth)),
s AS (
  SELECT depth, prefix, sum(bytes) AS shard_bytes FROM p GROUP BY depth, prefix HAVING sum(bytes) <= {sharding.SHARD_BYTES} OR min(bits) = max(bits)
), leaf AS (SELECT row_id, min(depth) AS depth FROM p JOIN s USING (depth, prefix) GROUP BY row_id)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS depth,
  CAST(bytes AS BIGINT) AS bytes, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_bytes > {sharding.SHARD_BYTES} AS oversized
FROM p JOIN leaf USING (row_id, depth) JOIN s USING (depth, prefix) JOIN (SELECT row_id, doc_id FROM k) USING (row_id)"""


def mix_sql(source: str) -> str:
    """CTEs `mixed` (all columns, topic, tokens, probability, kept) over a relation with the columns of documents."""
    ctes = [
        f"md AS (SELECT *, CAST(greatest(len(string_split_regex(regexp_replace(coalesce(text, ''), '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g'), '[ \\t-\\r]+')), 1) AS BIGINT) AS tokens, "
        f"{_BITS} / {float(1 << sharding.BITS)} AS draw, coalesce(source, '') AS d_source, coalesce(lang, '') AS d_lang FROM {source})",
        "mt AS (SELECT *, CASE WHEN contains(text, 'License') OR contains(text, 'Copyright') THEN 'legal' WHEN contains(text, ' | ') THEN 'tabular' "
        "WHEN contains(text, '=') OR contains(text, '://') OR contains(text, '@') THEN 'technical' WHEN tokens < 100 THEN 'short' "
        "WHEN tokens >= 1000 THEN 'long' ELSE 'article' END AS d_topic FROM md)",
        "w0 AS MATERIALIZED (SELECT d_source, d_lang, d_topic, sum(tokens) AS tokens, CAST(sum(tokens) AS DOUBLE) AS w FROM mt GROUP BY ALL)",
    ]
    for d in mixing.DIMENSIONS:
        ctes.append(
            f"t_{d} AS MATERIALIZED (SELECT d_{d}, x / sum(x) OVER () AS target FROM (SELECT d_{d}, pow(CAST(sum(tokens) AS DOUBLE), {mixing.TEMPER}) AS x FROM w0 GROUP BY d_{d}))"
        )
    step = 0
    for _ in range(mixing.SWEEPS):
        for d in mixing.DIMENSIONS:
            ctes.append(
                f"w{step + 1} AS MATERIALIZED (SELECT d_source, d_lang, d_topic, tokens, w * (target / sum(w) OVER (PARTITION BY d_{d})) AS w "
                f"FROM w{step} JOIN t_{d} USING (d_{d}))"
            )
            step += 1
    ctes.append(f"mp AS (SELECT d_source, d_lang, d_topic, (w / tokens) / max(w / tokens) OVER () AS probability FROM w{step})")
    ctes.append("mixed AS (SELECT mt.*, d_topic AS topic, probability, draw < probability AS kept FROM mt JOIN mp USING (d_source, d_lang, d_topic))")
    return ",\n".join(ctes)


def _backoff() -> str:
    ctes, order = [], backoff.ORDER
    for n in range(1, order + 1):
        ctes.append(f"g{n} AS (SELECT row_id, k, array_to_string(w[k - {n - 1} : k], ' ') AS g FROM d, unnest(range({n}, len(w) + 1)) AS t(k))")
        ctes.append(f"c{n} AS (SELECT g, count(*) AS c FROM g{n} GROUP BY g)")
    ctes.append(f"s1 AS (SELECT row_id, k, ln(c / (SELECT count(*) FROM g1)) AS s FROM g1 JOIN c1 USING (g))")
    for n in range(2, order + 1):
        # the context of the n-gram that ends at word k is the (n-1)-gram that ends at word k - 1
        ctes.append(f"m{n} AS (SELECT row_id, k, c{n}.c AS own, x.c AS context FROM g{n} JOIN c{n} USING (g) JOIN (SELECT row_id, k + 1 AS k, g AS cg FROM g{n - 1}) USING (row_id, k) JOIN c{n - 1} x ON x.g = cg)")
        ctes.append(
            f"s{n} AS (SELECT row_id, k, CASE WHEN own IS NULL THEN s WHEN own >= {backoff.MIN_COUNT} THEN ln(own / context) ELSE ln({backoff.ALPHA}) + s END AS s "
            f"FROM s{n - 1} LEFT JOIN m{n} USING (row_id, k))"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
{", ".join(ctes)}, t AS (SELECT row_id, sum(s ORDER BY k) AS total FROM s{order} GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(total, 0), 4) AS log_score, round(exp(-total / len(w)), 4) AS perplexity FROM d LEFT JOIN t USING (row_id)"""


def _spelling() -> str:
    checksum = "list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(length(x) / 2 AS BIGINT) + 1), lambda k: CAST('0x' || substr(x, 2 * k - 1, 2) AS BIGINT))), "
    checksum += "lambda a, b: xor(a >> 8, table_of[(xor(a, b) & 255) + 1]))"
    return f"""
WITH RECURSIVE powers AS (
  SELECT b, b AS v, 0 AS step FROM range(256) AS t(b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM powers WHERE step < 8
), crc AS (SELECT list(v ORDER BY b) AS table_of FROM powers WHERE step = 8), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= {spelling.MIN_LETTERS} GROUP BY ALL
), hashed AS (SELECT run, n, hex(encode(doc || ':' || run)) AS x FROM runs), checked AS (
  SELECT run, n, xor({checksum}, 4294967295) AS h FROM hashed, crc
), damaged AS (
  SELECT CASE WHEN h % {spelling.DAMAGED} = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM checked
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= {spelling.MIN_LETTERS} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}
), cut AS (SELECT word, n, k, left(word, k - 1) || substr(word, k + 1) AS rest FROM w, unnest(range(1, length(word) + 1)) AS t(k)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b USING (k, rest) WHERE a.word <> b.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON w.word = rest
  UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON w.word = rest
), best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {spelling.FORM_FACTOR} * w.n THEN top END AS form_n,
    CASE WHEN top >= {spelling.FORM_FACTOR} * w.n THEN (SELECT min(near) FROM near WHERE near.word = w.word AND near_n = top) END AS form
  FROM w LEFT JOIN best USING (word)
), up AS (
  SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT up.word, up.next, forms.form FROM up JOIN forms ON forms.word = up.next
)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN (SELECT word, root FROM up WHERE next IS NULL) USING (word)"""


ORACLES: dict[str, str] = {
    "op1_fm_index_decontamination": _DECONTAMINATION,
    "op3_stupid_backoff": _backoff(),
    "op4_line_bitmaps": _LINES,
    "op5_ownership_secrets": _secrets(),
    "op6_raked_mix": f"WITH {mix_sql('documents')}\nSELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability, kept FROM mixed",
    "op8_extendible_shards": _SHARDS,
    "op12_bidirectional_variants": _spelling(),
}
