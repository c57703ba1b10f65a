"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

from themeloom.llm.catalog import MIX

ORACLES: dict[str, str] = {}

ORACLES["op8_exact"] = r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
grouped AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM plain GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM plain JOIN grouped USING (norm)"""


def _weight(level: str) -> str:
    cases = "".join(f" WHEN '{n}' THEN {w}" for n, w in MIX.weights[level].items())
    return f"CASE {level}{cases} ELSE 1 END"


def _shared_out(nodes: str, parent: str, name: str) -> str:
    """``nodes`` (cap, weight, parent) with the budget of each: full nodes first, then by remainder."""
    part = f"PARTITION BY {parent}" if parent else ""
    order = f"{part} ORDER BY cap / weight::DOUBLE, {name}"
    return f"""
  SELECT *, CASE WHEN full_up THEN cap ELSE base END
    + CASE WHEN NOT full_up AND row_number() OVER ({part} ORDER BY CASE WHEN full_up THEN 0 ELSE rem END DESC, {name})
        <= pot - sum(CASE WHEN full_up THEN cap ELSE base END) OVER ({part}) THEN 1 ELSE 0 END AS budget
  FROM (SELECT *, (free * weight) // greatest(free_weight, 1) AS base, (free * weight) % greatest(free_weight, 1) AS rem
    FROM (SELECT *, pot - sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ({part}) AS free,
        sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER ({part}) AS free_weight
      FROM (SELECT *, cap * weight_after <= weight * (pot - cap_before) AS full_up
        FROM (SELECT *, least(parent, sum(cap) OVER ({part})) AS pot,
            sum(cap) OVER ({order}) - cap AS cap_before,
            sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_after
          FROM ({nodes}) WHERE weight > 0))))"""


_DOMAIN = "".join(
    f" WHEN source IN ({', '.join(repr(m) for m in members)}) THEN '{name}'"
    for name, members in MIX.domains.items()
)
_BARE = r"regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

ORACLES["op1_mixing"] = rf"""
WITH docs AS (
  SELECT doc_id, CASE{_DOMAIN} ELSE '{MIX.other_domain}' END AS domain, coalesce(lang, '(null)') AS lang,
    coalesce(source, '(null)') AS source, text,
    CASE WHEN bare = '' THEN 0 ELSE len(regexp_split_to_array(bare, '[\x20\x09-\x0D]+')) END AS n_tokens
  FROM (SELECT *, {_BARE} AS bare FROM documents)),
tree AS (
  SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {MIX.max_epochs} AS cap FROM docs GROUP BY ALL),
domains AS ({_shared_out(f'''SELECT domain, sum(cap) AS cap, {_weight('domain')} AS weight,
    (SELECT sum(tokens) * {MIX.numerator} // {MIX.denominator} FROM tree) AS parent FROM tree GROUP BY domain''', '', 'domain')}),
langs AS ({_shared_out(f'''SELECT tree.domain, lang, sum(tree.cap) AS cap, {_weight('lang')} AS weight, any_value(d.budget) AS parent
    FROM tree JOIN domains d USING (domain) GROUP BY tree.domain, lang''', 'domain', 'lang')}),
leaves AS ({_shared_out(f'''SELECT tree.domain, tree.lang, source, tree.tokens, tree.cap, {_weight('source')} AS weight, l.budget AS parent
    FROM tree JOIN langs l USING (domain, lang)''', 'domain, lang', 'source')}),
plan AS (SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest FROM leaves WHERE tokens > 0 AND budget > 0),
placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5('{MIX.seed}:' || CAST(epochs AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '(null)')), n_tokens, text
      ROWS UNBOUNDED PRECEDING) - n_tokens AS start
  FROM docs JOIN plan USING (domain, lang, source)),
taken AS (
  SELECT *, unnest(range(CAST(epochs AS BIGINT))) AS epoch, n_tokens AS take_tokens FROM placed
  UNION ALL
  SELECT *, CAST(epochs AS BIGINT), least(n_tokens, rest - start) FROM placed WHERE start < rest)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, CAST(n_tokens AS BIGINT) AS n_tokens,
  CAST(take_tokens AS BIGINT) AS take_tokens FROM taken"""

ORACLES["op3_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(replace(text, '\', '\\')) + (length(text) - length(replace(text, '<s>', ''))) // 3
      + (length(text) - length(replace(text, '</s>', ''))) // 4 + (length(text) - length(replace(text, '[INST]', ''))) // 6
      + (length(text) - length(replace(text, '[/INST]', ''))) // 7 AS text_chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN role IS NOT DISTINCT FROM before THEN 7 ELSE length(role) + 3 + 6 + 4 END) AS BIGINT)
    AS formatted_chars
FROM marked GROUP BY conv_id"""

ORACLES["op7_warc"] = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
keepers AS (SELECT html, max(page_id) AS keeper FROM payloads WHERE n >= 1000 GROUP BY html)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM payloads LEFT JOIN keepers USING (html)"""

# CRC-32 of the decimal digits of doc_id, bytewise by a table that is computed in place.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t)"""


def _crc32(codes: str) -> str:
    """``codes`` is a list of byte values."""
    step = "lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])"
    return f"xor(list_reduce({codes}, {step}, 4294967295::BIGINT), 4294967295)"


_KEY_CODES = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1)))"

ORACLES["op11_periodic"] = rf"""
WITH {_CRC_TABLE},
hashed AS (
  SELECT doc_id, w, len(w) AS n, {_crc32(_KEY_CODES)} AS h
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), crc_table),
placed AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS r FROM hashed),
planted AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n),
    lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // r) END]) END AS w FROM placed),
grams AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM planted)),
shifts AS (  -- the six words from i on are those from i + d on
  SELECT x.doc_id, x.i, y.i - x.i AS d FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i),
islands AS (
  SELECT doc_id, d, min(i) AS "start", count(*) + 5 AS common
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS island FROM shifts) GROUP BY doc_id, d, island),
runs AS MATERIALIZED (  -- of the periods of one stretch the smallest
  SELECT doc_id, "start", d + common AS length, min(d) AS period
  FROM islands WHERE d <= common AND d + common >= 12 GROUP BY doc_id, "start", d + common),
described AS (
  SELECT doc_id, count(*) AS n_runs, min(struct_pack(l := -length, s := "start", p := period)) AS best,
    string_agg("start" || ',' || length || ',' || period || chr(10), '' ORDER BY "start", period) AS listed
  FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range("start" + period, "start" + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM planted) ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS "start", -best.l AS length, best.p AS period,
  -best.l * 1000 // best.p AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM planted LEFT JOIN described USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

ORACLES["op12_ranked"] = rf"""
WITH tf AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
stats AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, stats GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), stats GROUP BY ALL),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ordered WHERE rank <= 10"""
