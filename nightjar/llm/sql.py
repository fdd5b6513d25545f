"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from nightjar.llm.feistel_shards import ROUNDS, SEED, SHARDS
from nightjar.llm.license_scan import LEAST_SHARE, TEMPLATES

_OP7 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER best AS keep_id, first_value(chars) OVER best AS keep_chars,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM d WINDOW best AS (PARTITION BY h ORDER BY chars DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND chars = keep_chars) AS kept, h AS text_sha256 FROM w
"""

_OP8 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, (place % 3 + 1)::DOUBLE AS w, (source_size * 3)::DOUBLE AS cap FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS rank FROM w
), f AS (
  SELECT min(rank) AS rank, arg_min(level, rank) AS level FROM l WHERE cap > w * level
), t AS (
  SELECT source, source_size, CASE WHEN coalesce(l.rank < f.rank, true) THEN cap ELSE w * f.level END AS target FROM l, f
), b AS (
  SELECT *, length(bin(size)) AS weight FROM d
), e AS (
  SELECT t.source, t.source_size, t.target, b.weight, sum(b.size) AS words FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
  GROUP BY ALL HAVING sum(b.size) > 0
), v AS (
  SELECT *, (target - 3 * coalesce(sum(words) OVER (down ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight * words) OVER (down ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level, row_number() OVER down AS place
  FROM e WINDOW down AS (PARTITION BY source ORDER BY weight DESC)
), k AS (
  SELECT *, min(CASE WHEN weight * level < 3 THEN place END) OVER own AS first_place, arg_min(level, place) FILTER (weight * level < 3) OVER own AS first_level
  FROM v WINDOW own AS (PARTITION BY source)
), h AS (
  SELECT *, CASE WHEN coalesce(place < first_place, true) THEN 3.0::DOUBLE ELSE weight * first_level END AS share FROM k
), p AS (
  SELECT *, least(floor(share), 3)::INTEGER AS whole, target - (sum(least(floor(share), 3)::INTEGER * words) OVER (PARTITION BY source))::DOUBLE AS rest FROM h
), r AS (
  SELECT b.doc_id, b.source, b.size, t.source_size, t.target, b.weight, coalesce(p.whole, 0) AS whole, coalesce(p.rest, 0) AS rest,
         (('0x' || substr(md5('nightjar-mix-1|' || coalesce(b.doc_id::VARCHAR, '-') || '|' || b.size::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u,
         (p.share - p.whole) / (1 - (p.share - p.whole)) AS inclusion
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source LEFT JOIN p ON b.source IS NOT DISTINCT FROM p.source AND b.weight = p.weight
), o AS (
  SELECT *, CASE WHEN inclusion > 0 AND size > 0 THEN u / (1 - u) / inclusion END AS odds FROM r
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds) ASC NULLS LAST, doc_id ASC NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM o
)
SELECT doc_id, size, source_size, target, source, weight::INTEGER AS weight,
       (whole + CASE WHEN odds IS NOT NULL AND rest > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END)::INTEGER AS copies,
       ((whole + CASE WHEN odds IS NOT NULL AND rest > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c
"""

_T = ", ".join(f"({i}, '{t.label}', {t.base}, {list(t.words)!r}, {t.key_at}, {list(t.key)!r})" for i, t in enumerate(TEMPLATES))

_OP6 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), t(i, label, base, words, key_at, key) AS (VALUES {_T}
), s AS (
  SELECT r, label, base, words, w, unnest(list_filter(range(-key_at, len(w)), lambda p: p + key_at >= 0 AND w[p + key_at + 1 : p + key_at + len(key)] = key)) AS p
  FROM d, t WHERE len(list_intersect(w, key)) > 0
), f AS (
  SELECT r, label, base, p,
         len(list_filter(range(0, len(words)), lambda k: p + k >= 0 AND w[greatest(p + k, 0) + 1] = words[k + 1])) / len(words)::DOUBLE AS share
  FROM s
), g AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(p) FILTER (base) AS first_word, max(p) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM f WHERE base OR share >= {LEAST_SHARE} GROUP BY r
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)
"""

_OP9 = r"""
WITH s AS (
  SELECT conv_id, turn, coalesce(regexp_replace(role, '[\s<>|]+', '_', 'g'), 'unknown') AS speaker,
         regexp_replace(coalesce(text, ''), '<\|im_', '<| im_', 'g') AS text FROM conversations
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM s WHERE speaker <> 'system'
), e AS (
  SELECT s.*, perspective, speaker = perspective AS own,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END AS shown_as
  FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), g AS (
  SELECT *, '<|im_start|>' || shown_as || chr(10) AS head, '<|im_start|>' || shown_as || chr(10) || text || '<|im_end|>' || chr(10) AS segment FROM e
), o AS (
  SELECT *, (row_number() OVER w - 1) AS place, (sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) - length(segment))::BIGINT AS start
  FROM g WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, segment)
)
SELECT conv_id, perspective, place, turn, speaker, shown_as, segment, start,
       CASE WHEN own THEN start + length(head) END AS mask_start, CASE WHEN own THEN start + length(segment) - 1 END AS mask_end
FROM o
"""



def _crc_step(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


def _mix(x: str) -> str:
    """Two multiply-xorshift steps over 64 bits, in numbers of 128 bits."""
    step = lambda v, shift: f"list_transform([{v}], lambda v: xor(v, v >> {shift}))[1]"
    times = lambda v, by: f"(({v})::UHUGEINT * {by} % 18446744073709551616)::UBIGINT"
    return step(times(step(times(step(x, 30), 0xBF58476D1CE4E5B9), 27), 0x94D049BB133111EB), 31)


_OP10 = f"""
WITH RECURSIVE t AS (SELECT {[_crc_step(i) for i in range(256)]}::UINTEGER[] AS crc_of
), c AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size,
         list_reduce(list_prepend(4294967295::UINTEGER, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UINTEGER)),
                     lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])) AS c
  FROM documents, t
), d AS (
  SELECT doc_id, size, xor(c, 4294967295::UINTEGER)::BIGINT AS text_crc32,
         (row_number() OVER (ORDER BY doc_id NULLS FIRST, size, xor(c, 4294967295::UINTEGER)) - 1)::UBIGINT AS place, (count(*) OVER ())::UBIGINT AS n FROM c
), h AS (
  SELECT greatest(1, (length(bin(greatest(max(n)::BIGINT - 1, 1))) + 1) // 2) AS half FROM d
), k AS (
  SELECT list({_mix(f"((i::UHUGEINT * 11400714819323198485 + {SEED}) % 18446744073709551616)::UBIGINT")} ORDER BY i) AS keys FROM range(1, {ROUNDS} + 1) r(i)
), f(place, n, half, low, keys, a, b, round) AS (
  SELECT place, n, half, (1::UBIGINT << half) - 1, keys, place >> half, place & ((1::UBIGINT << half) - 1), 0 FROM d, h, k
  UNION ALL
  SELECT place, n, half, low, keys, b, xor(a, {_mix("((b::UHUGEINT + keys[round % " + str(ROUNDS) + " + 1]) % 18446744073709551616)::UBIGINT")} & low), round + 1
  FROM f WHERE round = 0 OR round % {ROUNDS} > 0 OR (a << half) + b >= n
), p AS (
  SELECT place, ((a << half) + b)::BIGINT AS spot FROM f WHERE round > 0 AND round % {ROUNDS} = 0 AND (a << half) + b < n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (spot % {SHARDS})::INTEGER AS shard, spot // {SHARDS} AS slot, NULL::INTEGER AS grown_shard FROM d JOIN p USING (place)
"""

ORACLES: dict[str, str] = {
    "op10_feistel_shards": _OP10,
    "op6_license_scan": _OP6,
    "op9_perspective_rotation": _OP9,
    "op7_cuckoo_exact_dedup": _OP7,
    "op8_pareto_mix": _OP8,
}
