"""SQL over the same tables with the same rows as the registered queries, written from the semantics alone."""

from __future__ import annotations

from foliant.functions.intents import PROFILE_STOPWORDS
from foliant.operators.answer import NO_DOCUMENT, NOT_FOUND

WS = r"[\s\x0b\p{Z}\x{feff}]"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def count_re(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def words_re(*alternatives: str) -> str:
    return r"(?i)\b(?:" + "|".join(alternatives) + r")\b"


def toks(x: str) -> str:
    """Words, then trigrams of words of three characters or more."""
    return f"(SELECT list_concat(w, flatten(list_transform(list_filter(w, lambda v: length(v) >= 3), lambda v: list_transform(range(1, length(v) - 1), lambda k: substr(v, k, 3))))) FROM (SELECT regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9_/.:-]+') AS w))"


ITEM = f"""
split_line AS (
  SELECT doc_id, unnest(string_split(COALESCE(text, ''), chr(10))) AS raw, generate_subscripts(string_split(COALESCE(text, ''), chr(10)), 1) - 1 AS pos FROM documents
),
item AS (
  SELECT doc_id, CAST(pos // 40 + 1 AS INT) AS page_number, CAST(pos % 40 AS INT) AS item_ord, text, 0.08::DOUBLE AS x, (pos % 40) / 40.0::DOUBLE AS y, least(0.84::DOUBLE, length(text) / 100.0::DOUBLE) AS w, 0.015::DOUBLE AS h
  FROM (SELECT doc_id, pos, {collapse("raw")} AS text FROM split_line) WHERE text <> ''
)"""

CHUNK = f"""
{ITEM},
line AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY item_ord) AS rn FROM item),
fold AS (
  SELECT doc_id, page_number, rn, 0 AS chunk_ord, length(text) AS chars, y FROM line WHERE rn = 1
  UNION ALL
  SELECT l.doc_id, l.page_number, l.rn, f.chunk_ord + CAST(abs(l.y - f.y) > 0.08 OR f.chars + 1 + length(l.text) > 620 AS INT),
         CASE WHEN abs(l.y - f.y) > 0.08 OR f.chars + 1 + length(l.text) > 620 THEN length(l.text) ELSE f.chars + 1 + length(l.text) END, l.y
  FROM fold f JOIN line l ON l.doc_id = f.doc_id AND l.page_number = f.page_number AND l.rn = f.rn + 1
),
packed AS (
  SELECT doc_id, page_number, chunk_ord, string_agg(text, chr(10) ORDER BY rn) AS text, list(text ORDER BY rn) AS lines, COUNT(*) AS n, min(l.x) AS bx, min(l.y) AS b_y, max(l.x + l.w) - min(l.x) AS bw, max(l.y + l.h) - min(l.y) AS bh
  FROM fold f JOIN line l USING (doc_id, page_number, rn) GROUP BY doc_id, page_number, chunk_ord
  UNION ALL
  SELECT doc_id, page_number, 0, '[Image page — no text layer detected]', []::VARCHAR[], 0, 0.08, 0.08, 0.84, 0.84
  FROM (SELECT DISTINCT doc_id, CAST(pos // 40 + 1 AS INT) AS page_number FROM split_line) p ANTI JOIN item USING (doc_id, page_number)
),
chunk0 AS (SELECT *, 'p' || page_number || '-c' || (chunk_ord + 1) AS id, n = 0 AS is_fallback, {collapse("text")} AS compact FROM packed),
chunk1 AS (
  SELECT *, substr(compact, 1, 180) AS snippet, string_split(compact, ' ') AS ws, {count_re("compact", "[A-Z]")} AS ups, greatest({count_re("compact", "[A-Za-z]")}, 1) AS alphas FROM chunk0
),
chunk AS (
  SELECT *, CASE WHEN element_type = 'heading' THEN CASE WHEN b_y < 0.12 THEN 1 WHEN b_y < 0.25 THEN 2 ELSE 3 END END AS heading_level FROM (
    SELECT *, CASE WHEN is_fallback THEN 'image'
      WHEN {has("compact", r"(?i)^(figure|fig\.?)\s+[0-9]+[:.\-]?\s+")} OR {has("compact", r"(?i)^table\s+[0-9]+[:.\-]?\s+")} THEN 'caption'
      WHEN n >= 2 AND len(list_filter(lines, lambda v: {has("v", r"^(•|-|\*|[0-9]+[.)])\s+")})) >= greatest(2, ceil(n * 0.6)) THEN 'list'
      WHEN compact <> '' AND length(compact) <= 120 AND n <= 3 AND NOT {has("compact", "[.!?:;]$")} AND len(ws) <= 14
        AND (ups / alphas > 0.24 OR len(ws) > 1 AND len(list_filter(ws, lambda v: {has("v", "^[A-Z][a-z]")})) >= ceil(len(ws) * 0.6) AND b_y < 0.28) THEN 'heading'
      ELSE 'paragraph' END AS element_type FROM chunk1)
)"""

CHUNKS = "WITH RECURSIVE " + CHUNK
BOX = "round(bx, 6) AS box_x, round(b_y, 6) AS box_y, round(bw, 6) AS box_width, round(bh, 6) AS box_height"


def noisy(x: str) -> str:
    s = collapse(x)
    return f"(length({s}) < 40 OR {count_re(s, '[.]')} / length({s}) > 0.1 OR {count_re(s, '[a-zA-Z]')} / length({s}) < 0.35)"


def formula(x: str) -> str:
    s = collapse(x)
    return f"(len(list_filter(string_split({s}, ' '), lambda v: {has('v', '^[a-zA-Z0-9]$')})) / len(string_split({s}, ' ')) > 0.28 OR {count_re(s, '[=+×÷<>≤≥≈∑∏∫√-]')} / greatest(length({s}), 1) > 0.04)"


def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), ' [.] [0-9]+ ?$', ''))"


def _score(s: str, verbs: str, defines: str) -> str:
    return f"least(len(string_split({s}, ' ')) / 20, 1.0) + CASE WHEN {has(s, words_re(verbs))} THEN 0.3 ELSE 0 END + CASE WHEN {has(s, '[.!?]')} THEN 0.2 ELSE 0 END + CASE WHEN {has(s, words_re(defines))} THEN 0.5 ELSE 0 END"


def readability(x: str) -> str:
    return f"CASE WHEN {formula(x)} THEN 0.0 ELSE {_score(clean(x), 'is|are|was|were|has|have|can|will|define|describe|explain|show|mean|refer|state|present|propose|use', 'is defined as|is a |is an |refers to|we define|means that|can be described')} END"


def chunk_readability(x: str) -> str:
    s = collapse(x)
    return f"CASE WHEN length({s}) < 40 OR {formula(s)} THEN 0.0 ELSE {_score(s, 'is|are|was|were|has|have|can|will|define|present|describe', 'is defined as|is a |is an |refers to|we define')} END"


def truncate(x: str, n: int) -> str:
    c = clean(x)
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(substr({c}, 1, {n}), '{WS}+$', '') || '…' END"


STOP = "[" + ", ".join(f"'{w}'" for w in PROFILE_STOPWORDS) + "]"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, k: list_position({x}, v) = k)"


def profile_terms(x: str) -> str:
    t = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}'), lambda v: NOT list_contains({STOP}, v))"
    return distinct_in_order(t)


def clean_query(x: str) -> str:
    a = f"regexp_replace({x}, '{words_re('open', 'show', 'find', 'search', 'jump', 'go to', 'take me to', 'please', 'the', 'an?')}', ' ', 'g')"
    b = f"regexp_replace({a}, '{words_re('what is', 'what are', 'how does', 'how do', 'explain', 'tell me', 'describe', 'define', 'give me')}', ' ', 'g')"
    c = rf"regexp_replace({b}, '(?i)\bpage\s+[0-9]+\b', ' ', 'g')"
    return collapse(f"regexp_replace({c}, '[?!]+$', '')")


def flags(t: str) -> dict[str, str]:
    return {
        "correction": has(t, words_re("that’?s? (not|wrong|incorrect|bad)", "no[,.]? (that’?s?|it’?s?)", "not (what|a |the )", "again", "retry", "redo", "try again", "more detail", "expand", "elaborate")),
        "pointing": has(t, words_re("point (it|that)? out", "point me to", "show me where", "where is that", "where is it", "open that", "open it", "take me there", "jump there")),
        "summary_like": has(t, words_re("summar", "overview", "main point", "main idea", "what is this about", "what is the paper about", "whole document", "entire document", "big picture")),
        "broad": has(t, words_re("summar", "overview", "explain", "describe", "compare", "why", "how", "walk me through", "tell me about", "what does .* mean")),
        "summary": has(f"lower({t})", words_re("summar", "overview", "what is this", "what(‘s| is) (this|the (paper|doc|article))", "about", "main (point|topic|idea|finding|contribution|argument)", "tl;?dr", "in a nutshell")),
        "list": has(f"lower({t})", words_re("list", "enumerate", "what are (the|all)", "all the", "every", "each", "bullet")),
        "definition": has(f"lower({t})", words_re("what is (a |an |the )?", "define ", "meaning of ", "explain (what|how)", "how does")),
        "navigation": has(t, words_re("open", "show", "jump", "take me", "go to", "navigate")),
    }


FOLLOW = f"({flags('text')['correction']} OR {flags('text')['pointing']})"
RESOLVED = f"""
WITH m AS (
  SELECT *, row_number() OVER w AS n_messages, lag(upper(role) || ': ' || text, 1) OVER w AS h1, lag(upper(role) || ': ' || text, 2) OVER w AS h2,
    last_value(CASE WHEN role = 'user' AND len(regexp_split_to_array({strip("text")}, '{WS}+')) > 3 THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_substantive
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)"""

HITS = CHUNKS + ", hit AS (SELECT *, doc_id AS query_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number DESC, chunk_ord DESC) AS rank FROM chunk)"
POOL = f"""
{HITS},
clean_hit AS (SELECT *, max(NOT bad) OVER (PARTITION BY query_id) AS any_good FROM (SELECT *, {noisy("snippet")} AS bad FROM hit)),
kept AS (SELECT * FROM clean_hit WHERE NOT bad OR NOT any_good)"""
REFS = f"""
{POOL},
once AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY rank) = 1),
ref AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM once QUALIFY r <= 5)"""

VECTORS = """
WITH entry AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS vector, list_transform(range(0, 2), lambda w: list_sum(list_transform(range(0, 32), lambda b: CASE WHEN embedding[w * 32 + b + 1] >= 0 THEN 1::BIGINT << b ELSE 0 END))::BIGINT) AS sig FROM embeddings),
pair AS (
  SELECT q.vec_id AS query_id, e.vec_id, CAST(bit_count(e.sig[1] # q.sig[1]) + bit_count(e.sig[2] # q.sig[2]) AS INT) AS hamming, e.vector, q.vector AS qv FROM entry e, entry q WHERE q.vec_id % 50 = 0
),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hamming, vec_id) AS candidate FROM pair QUALIFY candidate <= 48)"""
VECTORS = VECTORS.replace("e.sig[1] # q.sig[1]", "xor(e.sig[1], q.sig[1])").replace("e.sig[2] # q.sig[2]", "xor(e.sig[2], q.sig[2])")

GROUPED = f"""
{CHUNKS},
scored AS (SELECT *, {chunk_readability("text")} AS readability FROM chunk),
pool AS (SELECT * FROM scored QUALIFY sum((readability > 0)::INT) OVER (PARTITION BY doc_id) < least(4, ceil(count(*) OVER (PARTITION BY doc_id) * 0.2)) OR readability > 0),
grouped AS (
  SELECT *, CAST(CASE WHEN m <= 8 THEN nth - 1 ELSE (nth - 1) // CAST(ceil(m / 8) AS BIGINT) END AS INT) AS group_ord
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, chunk_ord) AS nth FROM pool)
)"""
PROMPTS = f"""
{GROUPED},
part AS (
  SELECT doc_id, group_ord, first(compact ORDER BY readability DESC, page_number, chunk_ord) AS best, min(page_number) AS a, max(page_number) AS b FROM grouped GROUP BY doc_id, group_ord
),
prompt AS (
  SELECT doc_id, CAST(count(*) AS INT) AS num_groups, concat_ws(chr(10), 'Document: "Document ' || doc_id || '"',
    string_agg('[p.' || CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END || '] ' || substr(best, 1, 200) || CASE WHEN length(best) > 200 THEN '…' ELSE '' END, chr(10) ORDER BY group_ord) FILTER (length(best) >= 30)) AS memory_prompt
  FROM part GROUP BY doc_id
)"""
ENTRIES = PROMPTS + rf""",
entry_line AS (SELECT doc_id, unnest(string_split(memory_prompt, chr(10))) AS raw0, generate_subscripts(string_split(memory_prompt, chr(10)), 1) - 1 AS k FROM prompt),
entry AS (
  SELECT *, TRY_CAST(regexp_extract(page_label, '[0-9]+') AS INT) AS page_number, CASE WHEN page_label IS NULL THEN raw ELSE regexp_extract(raw, '^\[p\.[0-9]+(?:–[0-9]+)?\]\s*(.*)$', 1) END AS text FROM (
    SELECT e.doc_id, first(t.raw) AS title_line, CAST(e.k - 1 AS INT) AS ord, e.raw, nullif(regexp_extract(e.raw, '^\[(p\.[0-9]+(?:–[0-9]+)?)\]', 1), '') AS page_label
    FROM (SELECT *, {strip("raw0")} AS raw FROM entry_line) e JOIN (SELECT *, {strip("raw0")} AS raw FROM entry_line) t ON t.doc_id = e.doc_id AND t.k = 0 WHERE e.k > 0 GROUP BY e.doc_id, e.k, e.raw
  )
)"""
RANKED = f"""
{ENTRIES},
question AS (SELECT doc_id, {profile_terms("COALESCE(text, '')")}[1:5] AS terms FROM documents),
rated AS (
  SELECT e.*, terms, COALESCE(list_sum(list_transform(list_filter(terms, lambda t: contains(lower(COALESCE(page_label, '') || ' ' || text), t)), lambda t: least(length(t), 6))), 0) - CASE WHEN page_number = 1 THEN 0.75 ELSE 0 END
    - CASE WHEN {noisy("text")} THEN 1.5 ELSE 0 END - CASE WHEN {formula("text")} THEN 1.25 ELSE 0 END + least(length(text) / 180, 1.0) AS score
  FROM entry e JOIN question USING (doc_id)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_number NULLS LAST, ord) AS rank FROM rated)"""


def byte_units() -> str:
    out = "CASE WHEN n <= 0 THEN '0 B' WHEN n < 1024 THEN printf('%.0f B', n::DOUBLE)"
    for k, u in enumerate(("KB", "MB", "GB", "TB"), 1):
        v, limit = f"(n / 1024.0 ** {k})", f"n < 1024.0 ** {k + 1}" if k < 4 else "true"
        out += f" WHEN {limit} THEN CASE WHEN {v} >= 100 THEN printf('%d {u}', round({v})::BIGINT) ELSE printf('%.1f {u}', round({v}, 1)) END"
    return out + " END"


def layout_values(n_blocks: str = "greatest(n, 1)", ratio: str = "0.0") -> list[str]:
    flag = lambda w, v: f"CASE WHEN contains(text, '{w}') THEN {v} ELSE 0.0 END"
    share = lambda p: f"CASE WHEN length(text) > 0 THEN {count_re('text', p)} / length(text) ELSE 0.0 END"
    f = [
        "bx", "b_y", "bw", "bh", ratio, "least(length(text) / 700, 1.0)", share("[0-9]"), share("[A-Z]"), f"least({n_blocks} / 18, 1.0)", "least(n / 32, 1.0)",
        "CASE WHEN is_fallback THEN 1.0 ELSE 0.0 END", flag("table", 0.7), flag("figure", 0.6), flag("%", 0.3), flag("$", 0.3), f"least(len({toks('text')}) / 64, 1.0)",
    ]
    return [f"CAST({v} AS DOUBLE)" for v in f]


def layout_features() -> str:
    return ", ".join(f"round({v}, 6) AS f{k:02d}" for k, v in enumerate(layout_values()))


def embedded(source: str, key: str, name: str, n_blocks: str = "greatest(n, 1)", ratio: str = "0.0") -> str:
    """CTEs from ``source`` (key, text, box, n, is_fallback) to ``name``_vec: key, vec (floats) and sig (12 words)."""
    return f"""
{name}_tok AS (SELECT {key}, t, count(*) AS times FROM (SELECT {key}, unnest({toks("text")}) AS t FROM {source}) GROUP BY {key}, t),
{name}_hash AS (SELECT t, list_reduce(list_transform(string_split(t, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) % 368 AS bucket,
  CASE WHEN list_sum(list_transform(string_split(t, ''), lambda c: ascii(c) % 2)) % 2 = 1 THEN 1 ELSE -1 END * CASE WHEN length(t) > 5 THEN 28 WHEN length(t) > 3 THEN 20 ELSE 13 END AS weight FROM (SELECT DISTINCT t FROM {name}_tok)),
{name}_bucket AS (SELECT {key}, CAST(bucket AS INT) AS bucket, CAST(sum(times * weight) AS DOUBLE) / 20.0 AS w FROM {name}_tok JOIN {name}_hash USING (t) GROUP BY {key}, bucket),
{name}_map AS (SELECT {key}, MAP(list(bucket), list(w)) AS m FROM {name}_bucket GROUP BY {key}),
{name}_raw AS (SELECT {key}, list_concat(list_transform(range(0, 368), lambda k: COALESCE(m[k::INT], 0.0::DOUBLE)), [{", ".join(layout_values(n_blocks, ratio))}]) AS raw FROM {source} LEFT JOIN {name}_map USING ({key})),
{name}_unit AS (SELECT {key}, list_transform(raw, lambda x: CAST(x / size AS FLOAT)) AS vec FROM (SELECT {key}, raw, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS size FROM {name}_raw)),
{name}_vec AS (SELECT {key}, vec, list_transform(range(0, 12), lambda w: CAST(list_sum(list_transform(range(0, 32), lambda b: CASE WHEN vec[w * 32 + b + 1] >= 0 THEN 1::BIGINT << b ELSE 0 END)) AS BIGINT)) AS sig FROM {name}_unit)"""


def merged(source: str) -> str:
    """(key, m) of (key, l, r): l with what r adds to it."""
    lead = lambda x: f"regexp_replace({x}, '^{WS}+', '')"
    return f"""(SELECT key, CASE WHEN {strip("l")} = '' THEN tail WHEN {strip("r")} = '' OR rest = '' THEN l
        WHEN regexp_matches(rest, '^[,.;:!?)/\\]}}]') OR regexp_matches(l, '{WS}$') OR regexp_matches(r, '^{WS}') THEN l || rest ELSE l || ' ' || rest END AS m
      FROM (SELECT *, CASE WHEN o > 0 THEN {lead("substr(tail, o + 1)")} ELSE tail END AS rest
        FROM (SELECT *, COALESCE(list_max(list_filter(range(12, most + 1), lambda k: lower(right(l, k)) = lower(left(tail, k)))), 0) AS o
          FROM (SELECT *, least(80, length(l), length(tail)) AS most FROM (SELECT key, COALESCE(l, '') AS l, COALESCE(r, '') AS r, {lead("COALESCE(r, '')")} AS tail FROM {source})))))"""


def broken_off(x: str) -> str:
    t = strip(x)
    return f"""({t} <> '' AND NOT regexp_matches({t}, '[.!?]["''”’\\])}}]*$') AND (regexp_matches({t}, '[:;,(\\[{{/-]$') OR regexp_matches({t}, '[A-Za-z0-9\\])}}]$')))"""


EMBEDDED = f"{CHUNKS}, {embedded('chunk', 'doc_id, id', 'c')}"

POOLED = f"""
{REFS},
pool_scored AS (SELECT *, CASE WHEN bad THEN 0.0 ELSE {readability("snippet")} END AS pool_score FROM kept),
pool_ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pool_score DESC, rank) AS o FROM pool_scored),
pool_one AS (SELECT * FROM pool_ordered QUALIFY row_number() OVER (PARTITION BY query_id, page_number ORDER BY o) = 1),
pool_five AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS k FROM pool_one QUALIFY k <= 5),
said AS (SELECT p.query_id, p.k, {clean("p.snippet")} AS c, {formula("p.snippet")} AS f, COALESCE('[ref:r' || ref.r || ']', '[p.' || p.page_number || ']') AS cite FROM pool_five p LEFT JOIN ref ON ref.query_id = p.query_id AND ref.id = p.id)"""
QUESTION = "CASE doc_id % 4 WHEN 0 THEN 'Give me an overview' WHEN 1 THEN 'List all the points' WHEN 2 THEN 'What is the main result?' ELSE 'Where does it begin' END"

ROLES = """
model AS (SELECT CAST(n_nationkey AS INT) AS model, 'm' || n_nationkey || '.' AS prefix, CAST(n_nationkey % 4 AS INT) AS n_layers, CAST(2 + n_nationkey % 3 AS INT) AS every FROM nation),
role AS (SELECT * FROM (VALUES
  (0, 0, 'input_norm', 'input_layernorm.weight'), (0, 1, 'post_norm', 'post_attention_layernorm.weight'), (0, 2, 'gate', 'mlp.gate_proj.weight'), (0, 3, 'up', 'mlp.up_proj.weight'), (0, 4, 'down', 'mlp.down_proj.weight'),
  (1, 5, 'qkv', 'linear_attn.in_proj_qkv.weight'), (1, 6, 'z', 'linear_attn.in_proj_z.weight'), (1, 7, 'b', 'linear_attn.in_proj_b.weight'), (1, 8, 'a', 'linear_attn.in_proj_a.weight'), (1, 9, 'conv', 'linear_attn.conv1d.weight'),
  (1, 10, 'dt_bias', 'linear_attn.dt_bias'), (1, 11, 'a_log', 'linear_attn.A_log'), (1, 12, 'norm', 'linear_attn.norm.weight'), (1, 13, 'out', 'linear_attn.out_proj.weight'),
  (2, 5, 'q', 'self_attn.q_proj.weight'), (2, 6, 'k', 'self_attn.k_proj.weight'), (2, 7, 'v', 'self_attn.v_proj.weight'), (2, 8, 'o', 'self_attn.o_proj.weight'), (2, 9, 'q_norm', 'self_attn.q_norm.weight'), (2, 10, 'k_norm', 'self_attn.k_norm.weight')
) AS r(kind, nth, role, part)),
layer AS (SELECT model, prefix, CAST(l AS INT) AS layer, (l + 1) % every <> 0 AS linear FROM (SELECT *, unnest(range(0, n_layers)) AS l FROM model)),
plan AS (SELECT model, layer, linear, role, prefix || 'layers.' || layer || '.' || part AS name, CAST(layer * 100 + nth + 3 AS INT) AS ord FROM layer JOIN role ON kind = 0 OR kind = CASE WHEN linear THEN 1 ELSE 2 END),
needed AS (
  SELECT model, name, ord FROM plan UNION ALL SELECT model, prefix || 'embed_tokens.weight', 0 FROM model UNION ALL SELECT model, prefix || 'norm.weight', 1 FROM model UNION ALL SELECT model, prefix || 'lm_head.weight', 2 FROM model WHERE model % 7 <> 3
),
there AS (SELECT model, name, ord, ord * 70000 * (model + 1) AS bytes, name LIKE '%conv1d.weight' AND model % 2 = 0 AS wide FROM needed WHERE model % 3 > 0 OR ord % 11 > 0),
shifted AS (SELECT model, max(wide) AS shift FROM there GROUP BY model)"""


#: Hits of every user turn in its document, in place of HITS: search, or the named page's summary.
ASKED = f"""
{CHUNKS}, {RESOLVED.replace("WITH m AS", "m AS").strip()},
resolved AS (SELECT conv_id, turn, conv_id || '/' || turn AS query_id, conv_id AS doc_id, text AS prompt, CASE WHEN {FOLLOW} AND n_messages > 2 THEN COALESCE(last_substantive, text) ELSE text END AS question FROM m WHERE role = 'user'),
paged AS (SELECT *, doc_id IN (SELECT doc_id FROM documents) AS indexed, TRY_CAST(nullif(regexp_extract(prompt, '(?i)\\bpage\\s+([0-9]+)\\b', 1), '') AS INT) AS explicit_page FROM resolved),
routed AS (SELECT *, CASE WHEN explicit_page IS NULL THEN {clean_query("question")} ELSE '' END AS search_query, {flags("prompt")["navigation"]} OR {flags("prompt")["pointing"]} AS navigates FROM paged),
sized AS (SELECT doc_id, ceil(len(string_split(COALESCE(text, ''), chr(10))) / 40) AS page_count FROM documents),
whole AS (SELECT chunk.*, page_number / page_count AS page_ratio FROM chunk JOIN sized USING (doc_id)),
{embedded("whole", "doc_id, id", "c", ratio="page_ratio")},
asked AS (SELECT query_id, search_query AS text, 0.5::DOUBLE AS bx, 0.5::DOUBLE AS b_y, 1.0::DOUBLE AS bw, 1.0::DOUBLE AS bh, 0 AS n, false AS is_fallback FROM routed WHERE indexed AND search_query <> ''),
{embedded("asked", "query_id", "q", "0")},
term AS (SELECT query_id, {distinct_in_order("t")} AS terms FROM (SELECT query_id, list_filter({toks("text")}, lambda v: length(v) > 2) AS t FROM asked)),
pair AS (SELECT r.query_id, r.search_query AS query, c.doc_id, c.id, c.page_number, c.chunk_ord, c.text, c_vec.vec, q_vec.vec AS qv, list_sum(list_transform(range(1, 13), lambda k: bit_count(xor(c_vec.sig[k], q_vec.sig[k])))) AS h,
  CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(lower(c.text), t))) / len(terms) ELSE 0.0 END AS boost
  FROM routed r JOIN q_vec USING (query_id) JOIN term USING (query_id) JOIN whole c ON c.doc_id = r.doc_id JOIN c_vec ON c_vec.doc_id = c.doc_id AND c_vec.id = c.id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h - 12.0 * boost, doc_id, page_number, chunk_ord) AS candidate FROM pair QUALIFY candidate <= 96),
rated AS (SELECT *, list_dot_product(list_transform(vec, lambda x: x::DOUBLE), list_transform(qv, lambda x: x::DOUBLE)) + 0.18 * boost AS similarity FROM near),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate) AS rank, {collapse("text")} AS t FROM rated QUALIFY rank <= 12),
placed AS (SELECT *, instr(lower(t), lower(query)) - 1 AS p FROM best),
summed AS (SELECT doc_id, page_number, COALESCE(nullif(first(snippet ORDER BY chunk_ord), ''), 'Image-heavy page') AS summary FROM chunk GROUP BY doc_id, page_number),
hit AS (
  SELECT query_id, rank, id, page_number, CASE WHEN query = '' OR p < 0 THEN substr(t, 1, 180)
    ELSE CASE WHEN p > 60 THEN '...' ELSE '' END || substr(t, greatest(0, p - 60) + 1, least(length(t), p + length(query) + 90) - greatest(0, p - 60)) || CASE WHEN p + length(query) + 90 < length(t) THEN '...' ELSE '' END END AS snippet FROM placed
  UNION ALL SELECT query_id, 1, NULL, page_number, summary FROM routed JOIN summed ON summed.doc_id = routed.doc_id AND page_number = explicit_page
)"""
ANSWERED = POOLED.replace(HITS, ASKED)


SQL: dict[str, str] = {
    "ask_conversations": f"""{ANSWERED},
      cites AS (SELECT query_id, string_agg(cite, ' ' ORDER BY k) AS sources FROM (SELECT query_id, cite, min(k) AS k FROM said GROUP BY query_id, cite) GROUP BY query_id),
      folded AS (SELECT query_id, string_agg(c, chr(10) || chr(10) ORDER BY k) AS summary, string_agg('• ' || cite || ' ' || substr(c, 1, 200), chr(10) ORDER BY k) AS listed, first(cite || ' ' || c ORDER BY k) AS lead,
        string_agg('• ' || cite || ' ' || substr(c, 1, 160), chr(10) ORDER BY k) FILTER (k BETWEEN 2 AND 3 AND NOT f) AS related FROM said GROUP BY query_id),
      about AS (SELECT *, nullif({strip("regexp_extract(question, '(?i)what is (?:a |an |the )?([^" + chr(92) + "n" + chr(92) + "r]+?)[?.]*$', 1)")}, '') AS topic FROM routed),
      led AS (SELECT *, CASE WHEN topic IS NOT NULL THEN 'From the document on "' || topic || '":' || chr(10) || chr(10) ELSE 'From the document:' || chr(10) || chr(10) END AS preamble FROM about),
      worded AS (SELECT led.*, CASE WHEN lead IS NULL THEN '{NOT_FOUND}' WHEN {flags("question")["summary"]} THEN preamble || summary || chr(10) || chr(10) || 'Sources: ' || sources WHEN {flags("question")["list"]} THEN preamble || listed
        ELSE CASE WHEN {flags("question")["definition"]} THEN preamble ELSE '' END || lead || COALESCE(chr(10) || chr(10) || 'Related:' || chr(10) || related, '') END AS answer FROM led LEFT JOIN folded USING (query_id) LEFT JOIN cites USING (query_id))
      SELECT conv_id, turn, CASE WHEN indexed THEN 'grounded' ELSE 'fallback' END AS mode, CASE WHEN indexed THEN 'The language model is not loaded yet, so this answer uses retrieval only.' || chr(10) || chr(10) || answer ELSE '{NO_DOCUMENT}' END AS text,
        CASE WHEN indexed THEN CAST(2 + (explicit_page IS NOT NULL)::INT + (search_query <> '')::INT + (navigates AND query_id IN (SELECT query_id FROM hit))::INT AS INT) ELSE 0 END AS n_trace FROM worded""",
    "vision_patches": """WITH s AS (SELECT p_partkey, p_size + 3 AS w, p_size * 2 + 1 AS h FROM part), r AS (SELECT p_partkey, greatest(1, CAST(floor(w * (336 / greatest(w, h)) + 0.5) AS BIGINT)) AS w, greatest(1, CAST(floor(h * (336 / greatest(w, h)) + 0.5) AS BIGINT)) AS h FROM s)
      SELECT p_partkey, CAST(ceil(h / 14) AS INT) AS rows, CAST(ceil(w / 14) AS INT) AS cols, CAST(ceil(h / 14) * ceil(w / 14) AS INT) AS tokens, CAST(ceil(h / 14) * ceil(w / 14) * 14 * 14 * 3 AS INT) AS n_values FROM r""",
    "lora_adapters": """WITH p AS (SELECT * FROM (VALUES ('q', 32, 64), ('k', 32, 16), ('v', 32, 16), ('o', 32, 32)) AS p(proj, n_in, n_out)),
      matrix AS (SELECT layer, proj, mat, r, CASE WHEN mat = 'A' THEN n_in ELSE n_out END AS dims, CASE WHEN mat = 'A' THEN 1.0 ELSE 0.1 END AS scale, 'layer_' || layer || proj || '_' || mat || mat || r AS name
        FROM p, (SELECT unnest(range(0, 2)) AS layer), (SELECT unnest(['A', 'B']) AS mat), (SELECT unnest(range(0, 8)) AS r)),
      seeded AS (SELECT *, list_reduce(list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) AS seed FROM matrix),
      place AS (SELECT layer, proj, mat, r, dims, scale, i, list_reduce(list_transform(string_split(i::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, seed) % dims AS bucket,
        list_reduce(list_transform(string_split(i::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, (seed + 1) & 4294967295) % 2 = 1 AS plus FROM seeded, (SELECT unnest(range(0, 64)) AS i)),
      e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
      summed AS (SELECT vec_id, layer, proj, mat, r, any_value(scale) AS scale, any_value(dims) AS dims, bucket, sum(CASE WHEN plus THEN v ELSE -v END) AS x FROM e JOIN place USING (i) GROUP BY vec_id, layer, proj, mat, r, bucket),
      sized AS (SELECT vec_id, layer, proj, mat, r, any_value(dims) AS dims, any_value(scale) * sum(abs(CAST(x / size AS FLOAT)::DOUBLE)) AS mass FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id, layer, proj, mat, r)) AS size FROM summed) GROUP BY vec_id, layer, proj, mat, r)
      SELECT CAST(layer AS INT) AS layer, proj, mat, CAST(sum(dims) AS BIGINT) AS n, round(sum(mass), 1) AS mass FROM sized GROUP BY layer, proj, mat""",
    "hybrid_text_search": f"""{EMBEDDED},
      asked AS (SELECT item_id, text, 0.5::DOUBLE AS bx, 0.5::DOUBLE AS b_y, 1.0::DOUBLE AS bw, 1.0::DOUBLE AS bh, 0 AS n, false AS is_fallback FROM benchmark),
      {embedded("asked", "item_id", "q", "0")},
      term AS (SELECT item_id, text AS query, {distinct_in_order("t")} AS terms FROM (SELECT item_id, text, list_filter({toks("text")}, lambda v: length(v) > 2) AS t FROM asked)),
      pair AS (SELECT item_id, query, c.doc_id, c.id, c.page_number, c.chunk_ord, c.text, c_vec.vec, q_vec.vec AS qv, list_sum(list_transform(range(1, 13), lambda k: bit_count(xor(c_vec.sig[k], q_vec.sig[k])))) AS h,
        CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(lower(c.text), t))) / len(terms) ELSE 0.0 END AS boost FROM chunk c JOIN c_vec USING (doc_id, id), q_vec JOIN term USING (item_id)),
      near AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY h - 12.0 * boost, doc_id, page_number, chunk_ord) AS candidate FROM pair QUALIFY candidate <= 48),
      rated AS (SELECT *, list_dot_product(list_transform(vec, lambda x: x::DOUBLE), list_transform(qv, lambda x: x::DOUBLE)) + 0.18 * boost AS similarity FROM near),
      best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, candidate) AS rank, {collapse("text")} AS t FROM rated QUALIFY rank <= 6),
      found AS (SELECT *, instr(lower(t), lower(query)) - 1 AS p FROM best)
      SELECT item_id AS query_id, CAST(rank AS INT) AS rank, doc_id, id, round(similarity, 4) AS similarity, CASE WHEN query = '' OR p < 0 THEN substr(t, 1, 180)
        ELSE CASE WHEN p > 60 THEN '...' ELSE '' END || substr(t, greatest(0, p - 60) + 1, least(length(t), p + length(query) + 90) - greatest(0, p - 60)) || CASE WHEN p + length(query) + 90 < length(t) THEN '...' ELSE '' END END AS snippet FROM found""",
    "grounded_answer": f"""{POOLED},
      cites AS (SELECT query_id, string_agg(cite, ' ' ORDER BY k) AS sources FROM (SELECT query_id, cite, min(k) AS k FROM said GROUP BY query_id, cite) GROUP BY query_id),
      folded AS (SELECT query_id, string_agg(c, chr(10) || chr(10) ORDER BY k) AS summary, string_agg('• ' || cite || ' ' || substr(c, 1, 200), chr(10) ORDER BY k) AS listed, first(cite || ' ' || c ORDER BY k) AS best,
        string_agg('• ' || cite || ' ' || substr(c, 1, 160), chr(10) ORDER BY k) FILTER (k BETWEEN 2 AND 3 AND NOT f) AS related FROM said GROUP BY query_id)
      SELECT query_id, CASE query_id % 4 WHEN 0 THEN 'From the document:' || chr(10) || chr(10) || summary || chr(10) || chr(10) || 'Sources: ' || sources WHEN 1 THEN 'From the document:' || chr(10) || chr(10) || listed
        ELSE CASE WHEN query_id % 4 = 2 THEN 'From the document on "main result":' || chr(10) || chr(10) ELSE '' END || best || COALESCE(chr(10) || chr(10) || 'Related:' || chr(10) || related, '') END AS text FROM folded JOIN cites USING (query_id)""",
    "chat_requests": f"""{REFS},
      top AS (SELECT k.query_id, k.rank, CASE WHEN ref.r IS NULL THEN '' ELSE '[ref:r' || ref.r || '] ' END || '[p.' || k.page_number || '] ' || {truncate("k.snippet", 220)} AS line FROM kept k LEFT JOIN ref ON ref.query_id = k.query_id AND ref.id = k.id QUALIFY row_number() OVER (PARTITION BY k.query_id ORDER BY k.rank) <= 5),
      context AS (SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS found FROM top GROUP BY query_id)
      SELECT doc_id AS query_id, 'Conversation so far:' || chr(10) || 'USER: Hello' || chr(10) || 'ASSISTANT: Hello.' || chr(10) || chr(10) || 'Question: ' || {QUESTION} || chr(10) || 'Document context:' || chr(10) || found || chr(10) || 'Write a concise answer grounded in the document.' AS content,
        CASE WHEN doc_id % 4 = 0 THEN 192 ELSE 144 END AS max_tokens FROM documents JOIN context ON doc_id = query_id""",
    "merge_continuation": f"""WITH cut AS (SELECT doc_id AS key, substr(text, 1, length(text) // 2 + 10) AS l, translate(substr(text, greatest(length(text) // 2 - 9, 1)), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS r FROM documents)
      SELECT key AS doc_id, m AS merged FROM {merged("cut")}""",
    "continuation_fold": f"""WITH cut AS (SELECT doc_id AS key, CAST(ceil(length(text) / 3) AS BIGINT) AS w, text FROM documents),
      pass AS (SELECT key, substr(text, 1, w + 20) AS p0, substr(text, w + 1, w + 20) AS p1, substr(text, 2 * w + 1, w + 20) AS p2 FROM cut),
      one AS (SELECT key, m, {strip("COALESCE(p0, '')")} = '' OR NOT {broken_off("m")} AS done, p1, p2 FROM {merged("(SELECT key, '' AS l, p0 AS r FROM pass)")} JOIN pass USING (key)),
      two AS (SELECT key, CASE WHEN done THEN o.m ELSE n.m END AS m, CASE WHEN done THEN 1 ELSE 2 END AS used, done OR {strip("COALESCE(p1, '')")} = '' OR NOT {broken_off("n.m")} AS done, p2 FROM one o JOIN {merged("(SELECT key, m AS l, p1 AS r FROM one)")} n USING (key)),
      three AS (SELECT key, CASE WHEN done THEN o.m ELSE n.m END AS m, CASE WHEN done THEN used ELSE used + 1 END AS used FROM two o JOIN {merged("(SELECT key, m AS l, p2 AS r FROM two)")} n USING (key))
      SELECT key AS query_id, {strip("m")} AS text, CAST(used AS INT) AS passes FROM three""",
    "layer_plans": f"WITH {ROLES} SELECT model, layer, linear, role, name, ord FROM plan",
    "required_tensors": f"WITH {ROLES} SELECT model, name, ord FROM needed",
    "missing_tensors": f"WITH {ROLES} SELECT n.model, n.name, n.ord FROM needed n LEFT JOIN there t ON t.model = n.model AND t.name = n.name WHERE t.name IS NULL",
    "runtime_status": f"""WITH {ROLES},
      total AS (SELECT n.model, CAST(COALESCE(sum(bytes), 0) AS BIGINT) AS n, min_by(n.name, n.ord) FILTER (t.name IS NULL) AS absent FROM needed n LEFT JOIN there t ON t.model = n.model AND t.name = n.name GROUP BY n.model),
      shown AS (SELECT model, n, absent, {byte_units()} AS label FROM total),
      reasoned AS (SELECT *, CASE WHEN model % 7 = 3 THEN 'lm-head-unavailable' WHEN absent IS NOT NULL THEN 'missing-tensors:' || absent WHEN n > 67108864 THEN 'cold-start-too-large:' || label ELSE 'interactive-ready' END AS reason FROM shown)
      SELECT model, reason = 'interactive-ready' AS interactive, reason, n AS cold_start_bytes, label AS cold_start_label FROM reasoned""",
    "tensor_lookup": f"""WITH {ROLES} SELECT s.model, shift, (SELECT min_by(replace(name, 'layers.0.input_layernorm.weight', ''), ord) FROM there t WHERE t.model = s.model AND name LIKE '%layers.0.input_layernorm.weight') AS prefix,
      (SELECT min_by(name, ord) FROM there t WHERE t.model = s.model AND name LIKE '%conv1d.weight') AS conv FROM shifted s""",
    "shifted_norms": f"""WITH {ROLES}, marked AS (SELECT t.model, t.name, t.ord, CASE WHEN shift AND regexp_matches(name, '[.](input_layernorm|post_attention_layernorm|q_norm|k_norm|norm)[.]weight$') THEN 1 ELSE 0 END AS plus FROM there t JOIN shifted USING (model))
      SELECT model, name, 0.5::DOUBLE + plus AS first, ord / 2.0::DOUBLE + plus AS second FROM marked""",
    "stop_tokens": f"""WITH k AS (SELECT n_nationkey, list_concat(list_concat(CASE n_nationkey % 3 WHEN 0 THEN [n_nationkey, 7, 2] WHEN 1 THEN [n_nationkey] ELSE [] END, [n_nationkey % 5]), [2, n_nationkey + 1]) AS t FROM nation)
      SELECT n_nationkey, array_to_string({distinct_in_order("t")}, ',') AS stop FROM k""",
    "config_summary": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'TextForConditionalGeneration' WHEN 1 THEN 'linear_attention' WHEN 2 THEN 'Plain' ELSE 'unknown' END AS name,
      CASE c_custkey % 8 WHEN 0 THEN 'multimodal-conditional-generation' WHEN 4 THEN 'linear_attention,multimodal-conditional-generation' WHEN 5 THEN 'linear_attention' ELSE '' END AS unsupported FROM customer""",
    "model_config": """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 1 THEN 1536 WHEN 2 THEN 2560 ELSE 1024 END AS hidden_size, CASE s_suppkey % 5 WHEN 2 THEN 36 ELSE 28 END AS num_hidden_layers, CASE s_suppkey % 5 WHEN 2 THEN 32 ELSE 16 END AS num_attention_heads,
      8 AS num_key_value_heads, CASE s_suppkey % 5 WHEN 1 THEN 96 WHEN 2 THEN 80 ELSE 64 END AS head_dim FROM supplier""",
    "tensor_rows": """SELECT vec_id, 8 AS n, round(embedding[(vec_id % 8) * 8 + 1]::DOUBLE, 6) AS first, 64 AS whole, round(embedding[(vec_id % 8) * 4 + 4]::DOUBLE, 6) AS tap FROM embeddings""",
    "executor_status": """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'error' WHEN s_suppkey % 2 = 0 THEN 'ready' ELSE 'skipped' END AS status,
      CASE WHEN s_suppkey % 5 = 0 THEN 'failure ' || s_suppkey WHEN s_suppkey % 2 = 0 THEN 'executor-created' ELSE 'executor-conditions-not-met' END AS reason FROM supplier""",
    "progress_text": """WITH e AS (SELECT event_id AS k, CASE WHEN event_id % 4 = 0 THEN (event_id % 100) / 100 WHEN event_id % 4 = 1 THEN event_id % 100 END AS v FROM events),
      p AS (SELECT k, CAST(floor(COALESCE(CASE WHEN v <= 1 THEN v * 100 ELSE v END, CASE WHEN k % 5 > 0 THEN (k % 50) / 50 * 100 END) + 0.5) AS INT) AS percent FROM e)
      SELECT k AS event_id, percent, CASE WHEN k % 3 = 0 THEN 'Loading part-' || k % 7 || '.bin' || COALESCE(' (' || percent || '%)', '…') WHEN k % 2 = 0 THEN 'model: in use now' ELSE 'Preparing model…' END AS shown FROM p""",
    "chat_log": """WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant'),
      said AS (SELECT conv_id, turn, 0 AS nth, 'user' AS role, text FROM u UNION ALL SELECT u.conv_id, u.turn, 1, 'assistant', COALESCE(a.text, 'The answer failed. Ask again.') FROM u LEFT JOIN a USING (conv_id, turn))
      SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, nth) AS INT) AS ord, role, text FROM said""",
    "rel_right": "SELECT n_name, n FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) RIGHT JOIN nation ON c_nationkey = n_nationkey",
    "rel_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS INT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rel_sql": "WITH s AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT o_custkey AS c_custkey, round(total, 2) AS total FROM s WHERE total > (SELECT 2 * avg(total) FROM s)",
    "rel_approx_distinct": "SELECT true AS near, count(DISTINCT o_custkey) AS n_customers FROM orders",
    "scan_text_items": f"WITH {ITEM} SELECT doc_id, page_number, item_ord, text, round(x, 6) AS box_x, round(y, 6) AS box_y, round(w, 6) AS box_width, round(h, 6) AS box_height FROM item",
    "page_records": f"WITH {ITEM} SELECT doc_id, page_number, string_agg(text, ' ' ORDER BY item_ord) AS raw_text, count(*) AS n_items, round(min(x), 6) AS box_x, round(min(y), 6) AS box_y, round(max(x + w) - min(x), 6) AS box_width, round(max(y + h) - min(y), 6) AS box_height FROM item GROUP BY doc_id, page_number",
    "page_analysis": f"""WITH {ITEM}, page AS (SELECT DISTINCT doc_id, CAST(pos // 40 + 1 AS INT) AS page_number FROM split_line)
      SELECT doc_id, page_number, CASE WHEN count(item_ord) > 0 THEN 'pdf.js-text-layer' ELSE 'pdf.js-fallback' END AS source, CAST(greatest(count(item_ord), 1) AS INT) AS n_blocks,
        round(COALESCE(min(x), 0.08), 6) AS box_x, round(COALESCE(min(y), 0.08), 6) AS box_y, round(COALESCE(max(x + w) - min(x), 0.84), 6) AS box_width, round(COALESCE(max(y + h) - min(y), 0.84), 6) AS box_height
      FROM page LEFT JOIN item USING (doc_id, page_number) GROUP BY doc_id, page_number""",
    "chunk_pack": f"{CHUNKS} SELECT doc_id, page_number, chunk_ord, text, CAST(greatest(n, 1) AS INT) AS block_count, CAST(n AS INT) AS line_count, {BOX} FROM chunk",
    "chunk_snippets": f"{CHUNKS} SELECT doc_id, id, snippet FROM chunk",
    "page_summaries": f"{CHUNKS} SELECT doc_id, page_number, COALESCE(nullif(first(snippet ORDER BY chunk_ord), ''), 'Image-heavy page') AS summary, CAST(sum(greatest(n, 1)) AS BIGINT) AS block_count FROM chunk GROUP BY doc_id, page_number",
    "element_types": f"{CHUNKS} SELECT doc_id, id, element_type, heading_level FROM chunk",
    "sections": f"""{CHUNKS}, placed AS (SELECT *, sum((element_type = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY page_number, chunk_ord) AS section_ord FROM chunk)
      SELECT doc_id, CAST(section_ord AS INT) AS section_ord, CASE WHEN first(element_type ORDER BY page_number, chunk_ord) = 'heading' THEN first(compact ORDER BY page_number, chunk_ord) END AS heading,
        min(page_number) AS page_number, string_agg({strip("text")}, chr(10) ORDER BY page_number, chunk_ord) AS text, string_agg(id, ',' ORDER BY page_number, chunk_ord) AS chunk_ids FROM placed GROUP BY doc_id, section_ord""",
    "line_grouping": f"WITH {ITEM} SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY item_ord) - 1 AS INT) AS line_ord, text FROM item",
    "tokenize_counts": f"SELECT doc_id, CAST({count_re('lower(text)', '[a-z0-9][a-z0-9_/.:-]+')} AS INT) AS n_words, CAST(len(t) AS INT) AS n_tokens, CAST(len(list_distinct(t)) AS INT) AS n_distinct FROM (SELECT doc_id, text, {toks('text')} AS t FROM documents)",
    "fnv_buckets": f"""{CHUNKS}, tok AS (SELECT doc_id, unnest({toks("text")}) AS t FROM chunk WHERE element_type <> 'image'),
      counted AS (SELECT doc_id, t, count(*) AS n FROM tok GROUP BY doc_id, t),
      hashed AS (SELECT t, list_reduce(list_transform(string_split(t, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) AS h, list_sum(list_transform(string_split(t, ''), lambda c: ascii(c) % 2)) % 2 = 1 AS plus FROM (SELECT DISTINCT t FROM counted))
      SELECT doc_id, CAST(h % 368 AS INT) AS bucket, CAST(sum(n * CASE WHEN plus THEN 1 ELSE -1 END * CASE WHEN length(t) > 5 THEN 28 WHEN length(t) > 3 THEN 20 ELSE 13 END) AS BIGINT) AS weight FROM counted JOIN hashed USING (t) GROUP BY 1, 2""",
    "layout_features": f"{CHUNKS} SELECT doc_id, id, {layout_features()} FROM chunk",
    "query_terms": f"SELECT item_id, array_to_string({distinct_in_order('t')}, ' ') AS terms FROM (SELECT item_id, list_filter({toks('text')}, lambda v: length(v) > 2) AS t FROM benchmark)",
    "embed_norm": f"{EMBEDDED} SELECT doc_id, id, round(list_sum(list_transform(vec, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm, CAST(len(vec) AS INT) AS dims, CAST(len(sig) AS INT) AS words FROM c_vec",
    "embed_vectors": f"{EMBEDDED} SELECT doc_id, id, pos, round(v::DOUBLE, 6) AS v FROM (SELECT doc_id, id, CAST(generate_subscripts(vec, 1) - 1 AS INT) AS pos, unnest(vec) AS v FROM c_vec) WHERE v <> 0",
    "embed_signatures": f"{EMBEDDED} SELECT doc_id, id, {', '.join(f'sig[{k + 1}] AS word{k:02d}' for k in range(12))} FROM c_vec",
    "pack_signature": f"{VECTORS} SELECT vec_id, sig[1] AS word0, sig[2] AS word1 FROM entry",
    "hamming_matrix": f"{VECTORS} SELECT query_id, vec_id, hamming FROM pair",
    "prefilter_topk": f"{VECTORS} SELECT query_id, vec_id, hamming, CAST(candidate AS INT) AS candidate FROM near",
    "batch_search": f"{VECTORS} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, candidate) AS INT) AS rank, vec_id, hamming, round(s, 6) AS similarity FROM (SELECT *, list_dot_product(vector, qv) AS s FROM near) QUALIFY rank <= 6",
    "search_embeddings_topk": f"{VECTORS} SELECT vec_id, hamming, round(s, 6) AS similarity FROM (SELECT *, list_dot_product(vector, qv) AS s FROM near WHERE query_id = 0) ORDER BY s DESC, hamming, vec_id LIMIT 6",
    "keyword_overlap": f"""WITH q AS (SELECT item_id AS query_id, {distinct_in_order('t')} AS terms FROM (SELECT item_id, list_filter({toks('text')}, lambda v: length(v) > 2) AS t FROM benchmark WHERE item_id % 50 = 0))
      SELECT query_id, doc_id, round(o, 6) AS overlap FROM (SELECT query_id, doc_id, len(list_filter(terms, lambda t: contains(lower(text), t))) / len(terms) AS o FROM documents, q) WHERE o > 0.5""",
    "query_snippet": f"""WITH q AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS q FROM benchmark WHERE item_id % 50 = 0),
      found AS (SELECT query_id, doc_id, q, c, instr(lower(c), lower(q)) - 1 AS p FROM (SELECT query_id, doc_id, q, {collapse("text")} AS c FROM documents, q))
      SELECT query_id, doc_id, CASE WHEN q = '' OR p < 0 THEN substr(c, 1, 180) ELSE CASE WHEN p > 60 THEN '...' ELSE '' END || substr(c, greatest(0, p - 60) + 1, least(length(c), p + length(q) + 90) - greatest(0, p - 60)) || CASE WHEN p + length(q) + 90 < length(c) THEN '...' ELSE '' END END AS snippet FROM found""",
    "open_chunk": f"{CHUNKS} SELECT d.doc_id, 'p1-c2' AS id, page_number, {BOX} FROM documents d LEFT JOIN chunk c ON c.doc_id = d.doc_id AND c.id = 'p1-c2'",
    "peek_page": f"{CHUNKS} SELECT d.doc_id, 2 AS page_number, first(snippet ORDER BY chunk_ord) AS summary FROM documents d LEFT JOIN chunk c ON c.doc_id = d.doc_id AND page_number = 2 GROUP BY d.doc_id",
    "open_page": f"WITH {ITEM}, n AS (SELECT doc_id, CAST(max(pos // 40 + 1) AS INT) AS page_count FROM split_line GROUP BY doc_id) SELECT doc_id, greatest(1, least(CAST(doc_id % 5 AS INT), page_count)) AS page_number, page_count FROM n",
    "clean_query": f"SELECT conv_id, turn, {clean_query('text')} AS search_query FROM conversations",
    "intent_flags": "SELECT conv_id, turn, " + ", ".join(f'{v} AS "{k}"' for k, v in flags("text").items()) + " FROM conversations",
    "explicit_page": rf"SELECT conv_id, turn, TRY_CAST(nullif(regexp_extract(text, '(?i)\bpage\s+([0-9]+)\b', 1), '') AS INT) AS page, nullif({strip(chr(32) + 'regexp_extract(text, ' + chr(39) + '(?i)what is (?:a |an |the )?(.+?)[?.]*$' + chr(39) + ', 1)')}, '') AS topic FROM conversations",
    "effective_prompt": f"{RESOLVED} SELECT conv_id, turn, text AS prompt, CASE WHEN {FOLLOW} AND n_messages > 2 THEN COALESCE(last_substantive, text) ELSE text END AS question, last_substantive FROM m WHERE role = 'user'",
    "chat_history": f"{RESOLVED} SELECT conv_id, turn, concat_ws(chr(10), h2, h1) AS history FROM m WHERE role = 'user'",
    "profile_terms": f"SELECT conv_id, turn, array_to_string({profile_terms('text')}, ' ') AS terms, CAST(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda v: v <> '')) AS INT) AS n_tokens FROM conversations",
    "noisy_flag": f"SELECT doc_id, {noisy('text')} AS noisy FROM documents",
    "formula_flag": f"SELECT doc_id, {formula('text')} AS formula FROM documents",
    "readability": f"{CHUNKS} SELECT doc_id, id, round({readability('snippet')}, 6) AS score FROM chunk",
    "chunk_readability": f"{CHUNKS} SELECT doc_id, id, round({chunk_readability('text')}, 6) AS score FROM chunk",
    "clean_snippet": f"{CHUNKS} SELECT doc_id, id, {clean('text')} AS clean FROM chunk",
    "quality_confusion": f"SELECT quality, {noisy('text')} AS noisy, {formula('text')} AS formula, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "dedupe_chunk": f"{HITS} SELECT query_id, CAST(rank AS INT) AS rank, substr(snippet, 1, 12) AS id FROM hit QUALIFY row_number() OVER (PARTITION BY query_id, substr(snippet, 1, 12) ORDER BY rank) = 1",
    "dedupe_page": f"{HITS} SELECT query_id, CAST(rank AS INT) AS rank, page_number FROM hit QUALIFY row_number() OVER (PARTITION BY query_id, page_number ORDER BY rank) = 1",
    "region_references": f"{REFS} SELECT query_id, CAST(r AS INT) AS ref_ord, 'r' || r AS ref_id, id AS chunk_id, page_number, 'p.' || page_number || ' · r' || r AS label, {truncate('snippet', 120)} AS ref_snippet FROM ref",
    "citations": f"{REFS} SELECT h.query_id, CAST(h.rank AS INT) AS rank, h.id, COALESCE('[ref:r' || ref.r || ']', '[p.' || h.page_number || ']') AS citation FROM hit h LEFT JOIN ref ON ref.query_id = h.query_id AND ref.id = h.id",
    "answer_pool": f"""{POOL}, scored AS (SELECT *, CASE WHEN bad THEN 0.0 ELSE {readability("snippet")} END AS pool_score FROM kept),
      ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pool_score DESC, rank) AS o FROM scored),
      one AS (SELECT * FROM ordered QUALIFY row_number() OVER (PARTITION BY query_id, page_number ORDER BY o) = 1)
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) AS INT) AS pool_rank, id, round(pool_score, 6) AS pool_score FROM one QUALIFY pool_rank <= 5""",
    "navigation_targets": f"{POOL} SELECT query_id, first(id ORDER BY rank) AS target_id, first(page_number ORDER BY rank) AS target_page FROM kept GROUP BY query_id",
    "truncate_prompt": f"SELECT doc_id, {truncate('text', 220)} AS short FROM documents",
    "truncated_answer": rf"SELECT conv_id, turn, CASE WHEN s = '' THEN false WHEN {has('s', r'[.!?][' + chr(34) + chr(39) * 2 + r'”’\])}]*$')} THEN false WHEN {has('s', r'[:;,(\[{/-]$')} THEN true ELSE {has('s', r'[A-Za-z0-9\])}]$')} END AS truncated FROM (SELECT conv_id, turn, {strip('text')} AS s FROM conversations)",
    "meta_groups": f"{GROUPED} SELECT doc_id, id, group_ord FROM grouped",
    "meta_embedding": f"""{GROUPED}, {embedded("chunk", "doc_id, id", "c")},
      part AS (SELECT g.doc_id, g.group_ord, greatest(readability, 0.05) AS w, generate_subscripts(vec, 1) - 1 AS pos, unnest(vec)::DOUBLE AS v FROM grouped g JOIN c_vec USING (doc_id, id)),
      mean AS (SELECT doc_id, group_ord, pos, sum(w * v) / sum(w) AS m FROM part GROUP BY doc_id, group_ord, pos)
      SELECT doc_id, group_ord, CAST(pos AS INT) AS pos, round(v, 6) AS v FROM (SELECT doc_id, group_ord, pos, m / sqrt(sum(m * m) OVER (PARTITION BY doc_id, group_ord)) AS v FROM mean) WHERE round(v, 6) <> 0""",
    "memory_prompt": f"{PROMPTS} SELECT doc_id, num_groups, memory_prompt FROM prompt",
    "profile_parse": f"{ENTRIES} SELECT doc_id, title_line, ord, page_label, page_number, text FROM entry WHERE text <> ''",
    "profile_rank": f"{RANKED} SELECT doc_id AS query_id, CAST(rank AS INT) AS rank, ord, round(score, 6) AS score FROM ranked",
    "profile_context": f"""{RANKED}, chosen AS (SELECT *, max(score > 0) OVER (PARTITION BY doc_id) AS good, count(*) OVER (PARTITION BY doc_id) AS total FROM ranked)
      SELECT doc_id AS query_id, 'Document profile:' || chr(10) || {truncate('first(title_line)', 90)} || chr(10) || string_agg(COALESCE('[' || page_label || '] ', '') || {truncate('text', 130)}, chr(10) ORDER BY rank) || chr(10) AS prefix,
        CASE WHEN NOT first(good) THEN 'fallback' WHEN len(first(terms)) > 0 THEN 'query-match' ELSE 'global-context' END AS reason, CAST(first(total) AS INT) AS sections, CAST(count(*) + 1 AS INT) AS lines_used
      FROM chosen WHERE rank <= 2 AND (score > 0 OR NOT good) GROUP BY doc_id""",
    "absolute_bbox": f'{CHUNKS} SELECT doc_id, id, round(bx * 612.0, 1) AS "left", round(792.0 - (b_y + bh) * 792.0, 1) AS bottom, round((bx + bw) * 612.0, 1) AS "right", round(792.0 - b_y * 792.0, 1) AS top FROM chunk',
    "layout_kids": f"{CHUNKS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, chunk_ord) AS INT) AS kid_id, element_type AS type, page_number, CASE WHEN element_type <> 'image' THEN compact END AS content, heading_level FROM chunk",
    "layout_export": f"""{CHUNKS},
      s AS (SELECT doc_id, CAST(count(*) FILTER (element_type = 'heading') + CAST(first(element_type ORDER BY page_number, chunk_ord) <> 'heading' AS INT) AS INT) AS n_sections, CAST(count(*) AS INT) AS n, count(DISTINCT page_number) AS pages FROM chunk GROUP BY doc_id),
      f AS (SELECT * FROM chunk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_number, chunk_ord) = 1),
      cs AS (SELECT doc_id, md5(string_agg(concat_ws('|', id, page_number, element_type, COALESCE(heading_level::VARCHAR, '-'), snippet, text), chr(10) ORDER BY page_number, chunk_ord)) AS chunks_md5 FROM chunk GROUP BY doc_id),
      pg AS (SELECT doc_id, page_number, COALESCE(nullif(first(snippet ORDER BY chunk_ord), ''), 'Image-heavy page') AS summary, sum(greatest(n, 1)) AS blocks FROM chunk GROUP BY doc_id, page_number),
      ps AS (SELECT doc_id, md5(string_agg(page_number || '|' || summary || '|' || blocks, chr(10) ORDER BY page_number)) AS pages_md5 FROM pg GROUP BY doc_id)
      SELECT doc_id, chunks_md5, pages_md5, doc_id || '.layout.json' AS file_name, s.n AS n_chunks, s.n AS n_kids, n_sections, doc_id || '.pdf' AS title, CAST(pages AS VARCHAR) AS page_count, doc_id || '.pdf' AS pdf_name, id AS first_id, text AS first_text, element_type AS first_type,
        snippet AS first_snippet, element_type AS first_kid, COALESCE(nullif(snippet, ''), 'Image-heavy page') AS first_summary, CASE WHEN element_type = 'heading' THEN compact END AS first_heading, id AS first_member FROM f JOIN s USING (doc_id) JOIN cs USING (doc_id) JOIN ps USING (doc_id)""",
    "snapshot_latest": "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10",
    "snapshot_lookup": "SELECT event_id, user_id, event_type FROM events WHERE event_id = 7",
    "key_file_presence": "SELECT n_name AS path, n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AS exists FROM nation",
    "softmax": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings) SELECT vec_id, CAST(generate_subscripts(e, 1) - 1 AS INT) AS pos, round(unnest(e) / list_sum(e), 6) AS p FROM e",
    "rmsnorm": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings) SELECT vec_id, CAST(generate_subscripts(e, 1) - 1 AS INT) AS pos, round(unnest(e) / sqrt(list_dot_product(e, e) / len(e) + 1e-6), 5) AS x FROM e",
    "dot_products": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings) SELECT vec_id, round(list_dot_product(e, list_reverse(e)), 6) AS dot, round(e[1] + e[-1], 6) AS first_sum FROM e",
    "matmul": "WITH c AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i FROM embeddings) SELECT a.label, a.i, b.i AS j, round(sum(a.v * b.v), 4) + 0.0 AS s FROM c a JOIN c b USING (label, vec_id) GROUP BY 1, 2, 3",
    "argmax": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS place FROM embeddings",
    "clamp_tail": "SELECT doc_id, array_to_string(string_split(text, ' ')[-5:], ' ') AS tail FROM documents",
    "swiglu": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings) SELECT vec_id, CAST(k - 1 AS INT) AS pos, round(e[k] / (1 + exp(-e[k])) * e[65 - k], 6) + 0.0 AS x FROM e, range(1, 65) AS r(k)",
    "activations": "SELECT c_custkey, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(CASE WHEN x > 20 THEN x WHEN x < -20 THEN exp(x) ELSE ln(1 + exp(x)) END, 6) AS softplus, round(x / (1 + exp(-x)), 6) AS silu FROM (SELECT c_custkey, c_acctbal / 300 AS x FROM customer)",
    "heads": "SELECT vec_id, 4 AS n, round(embedding[2 * 16 + 4], 6) AS x, true AS same FROM embeddings",
    "rotary": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), t AS (SELECT vec_id, e, k, k - k % 2 AS p, 3 * 10000.0 ** (-(k - k % 2) / 64.0) AS a FROM e, range(0, 64) AS r(k))
      SELECT vec_id, CAST(k AS INT) AS pos, round(CASE WHEN k % 2 = 0 THEN e[p + 1] * cos(a) - e[p + 2] * sin(a) ELSE e[p + 1] * sin(a) + e[p + 2] * cos(a) END, 5) + 0.0 AS x FROM t""",
    "resize_grid": """WITH s AS (SELECT p_partkey, p_size * 7 + 3 AS w, p_size * 5 + 11 AS h FROM part), r AS (SELECT p_partkey, greatest(1, CAST(floor(w * (336 / greatest(w, h)) + 0.5) AS BIGINT)) AS width, greatest(1, CAST(floor(h * (336 / greatest(w, h)) + 0.5) AS BIGINT)) AS height FROM s)
      SELECT p_partkey, width, height, CAST(ceil(width / 14) AS BIGINT) AS cols, CAST(ceil(height / 14) AS BIGINT) AS rows, CAST(ceil(width / 14) * ceil(height / 14) AS BIGINT) AS tokens FROM r""",
    "format_bytes": f"SELECT p_partkey, {byte_units()} AS shown FROM (SELECT p_partkey, p_partkey * p_partkey * p_size * 37 AS n FROM part)",
    "relative_paths": "SELECT page_id, regexp_replace(url, '[^/]*$', '') || 'shard-1.safetensors' AS path FROM pages",
    "hex_key": "SELECT page_id, 'blob-' || lower(hex(encode(url))) AS key FROM pages",
    "url_path": "SELECT p_partkey, replace(p_type || '/' || p_name, ' ', '%20') AS path FROM part",
    "escape_html": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages",
    "url_allowlist": f"SELECT page_id, CASE WHEN lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('', 'http', 'https', 'mailto') THEN {strip('u')} END AS safe FROM (SELECT page_id, ['', 'javascript:', 'MAILTO:a@', 'data:'][page_id % 4 + 1] || url AS u FROM pages)",
    "md_line_class": rf"""SELECT doc_id, CASE WHEN {has("l", f"^{WS}*$")} THEN 'blank' WHEN {has("l", "^```")} THEN 'fence' WHEN {has("l", r"^#{1,6}\s+")} THEN 'heading' WHEN {has("l", r"^\s*>\s?")} THEN 'quote' WHEN {has("l", r"^\s*[-*+]\s+")} THEN 'unordered'
      WHEN {has("l", r"^\s*[0-9]+\.\s+")} THEN 'ordered' WHEN {has("trim(l)", "^---+$")} THEN 'rule' ELSE 'paragraph' END AS kind, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY ALL""",
    "sanitize_generated": f"SELECT conv_id, turn, {collapse('text')} AS clean FROM conversations",
    "document_titles": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND {strip('text')} <> '' THEN {strip('text')} WHEN doc_id % 2 = 0 THEN doc_id || '.pdf' ELSE 'Untitled' END AS title FROM documents",
    "inactivity_sessions": """WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CAST(COALESCE(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 90 SECOND, true) AS INT) AS new FROM events))
      SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 90 SECOND) AS expires, count(*) AS n_events FROM g GROUP BY user_id, s""",
    "event_state": """WITH e AS (SELECT user_id AS request_id, event_id AS seq, event_id % 9 AS k FROM events),
      s AS (SELECT *, CASE WHEN k IN (0, 1) THEN 'loading' WHEN k IN (2, 5, 8) THEN 'ready' WHEN k = 3 THEN 'generating' WHEN k = 7 THEN 'error' END AS st, CASE WHEN k = 2 THEN true WHEN k IN (0, 1, 7) THEN false END AS rd FROM e),
      a AS (SELECT request_id, arg_max(st, seq) FILTER (st IS NOT NULL) AS st, arg_max(rd, seq) FILTER (rd IS NOT NULL) AS rd, max(seq) FILTER (st IS NOT NULL) AS last_at, max(seq) FILTER (k = 6) AS i, count(*) AS n FROM s GROUP BY request_id)
      SELECT request_id, CASE WHEN COALESCE(i > COALESCE(last_at, -1), false) AND COALESCE(rd, false) THEN 'ready' ELSE COALESCE(st, 'idle') END AS status, COALESCE(rd, false) AS ready, n AS n_events FROM a""",
    "cumulative_text": "SELECT conv_id AS request_id, turn AS seq, string_agg(COALESCE(text, ''), '') OVER (PARTITION BY conv_id ORDER BY turn) AS text_so_far FROM conversations",
    "rel_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "rel_joins": "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "rel_full_outer": "SELECT COALESCE(c_nationkey, s_nationkey) AS nationkey, n_customers, n_suppliers FROM (SELECT c_nationkey, count(*) AS n_customers FROM customer WHERE c_acctbal > 0 GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey",
    "rel_window": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS r FROM orders QUALIFY r <= 2",
    "rel_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "rel_setops": "SELECT k, 'both' AS part FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT DISTINCT k, 'more' FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)",
    "rel_distinct": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers, CAST(sum(DISTINCT o_custkey % 100) AS BIGINT) AS s FROM orders GROUP BY 1",
    "sketch_distinct": """WITH c AS (SELECT kind, strftime(ts, '%Y-%m') AS month, client_id, md5('0|' || client_id) AS h FROM clicks),
      x AS (SELECT kind, month, ('0x' || substr(h, 1, 3))::INT AS register, ('0x' || substr(h, 4, 12))::BIGINT AS rest FROM c WHERE client_id IS NOT NULL),
      r AS (SELECT kind, month, register, max(CASE WHEN rest = 0 THEN 49 ELSE 48 - length(bin(rest)) + 1 END) AS rank FROM x GROUP BY ALL),
      m AS (SELECT kind, month, 4096.0 - count(*) AS empty, sum(2.0 ** (-rank)) AS mass FROM r GROUP BY ALL),
      e AS (SELECT kind, month, empty, 0.7213 / (1 + 1.079 / 4096.0) * 4096.0 * 4096.0 / (mass + empty) AS raw FROM m),
      n AS (SELECT kind, month, CASE WHEN raw <= 2.5 * 4096 AND empty > 0 THEN 4096.0 * ln(4096.0 / empty) ELSE raw END AS estimate FROM e),
      t AS (SELECT kind, month, count(DISTINCT client_id) AS exact FROM c GROUP BY ALL)
      SELECT t.kind, t.month, round(estimate, 6) AS estimate, exact, true AS near FROM t JOIN n ON t.kind IS NOT DISTINCT FROM n.kind AND t.month IS NOT DISTINCT FROM n.month""",
    "sketch_quantiles": """WITH b AS (SELECT status, CAST(sign(total) AS INT) AS s, CAST(CASE WHEN total = 0 THEN 0 ELSE ceil(ln(abs(total)) / ln(1.01 / 0.99)) END AS INT) AS bucket, count(*) AS n FROM sales WHERE total IS NOT NULL AND NOT isnan(total) GROUP BY ALL),
      r AS (SELECT *, sum(n) OVER (PARTITION BY status ORDER BY s, s * bucket) AS upto, sum(n) OVER (PARTITION BY status) AS total FROM b)
      SELECT status, share, round(CASE WHEN s = 0 THEN 0.0 ELSE s * 2 * (1.01 / 0.99) ** bucket / (1.01 / 0.99 + 1) END, 6) AS value FROM r, (VALUES (0.01::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) q(share)
      WHERE upto >= greatest(1, ceil(share * total)) AND upto - n < greatest(1, ceil(share * total))""",
    "sketch_counts": """WITH cell AS (SELECT line, item_id, ('0x' || substr(md5((line + 1) || '|' || item_id), 1, 8))::BIGINT % 4096 AS cell FROM (SELECT DISTINCT item_id FROM sale_lines WHERE item_id IS NOT NULL UNION SELECT item_id FROM items WHERE item_id % 100 = 0), range(0, 4) AS l(line)),
      state AS (SELECT line, cell, sum(n) AS n FROM cell JOIN (SELECT item_id, count(*) AS n FROM sale_lines GROUP BY 1) USING (item_id) GROUP BY ALL)
      SELECT item_id, CAST(min(COALESCE(n, 0)) AS BIGINT) AS estimate FROM cell LEFT JOIN state USING (line, cell) WHERE item_id IN (SELECT item_id FROM items WHERE item_id % 100 = 0) GROUP BY 1""",
    "rel_bottom_k": "SELECT status, sale_id, total, CAST(row_number() OVER (PARTITION BY status ORDER BY ('0x' || substr(md5('0|' || sale_id), 1, 12))::BIGINT, sale_id) AS INT) AS sample_rank FROM sales QUALIFY sample_rank <= 20",
    "rel_pivot": "SELECT nation_id, " + ", ".join(f"count(*) FILTER (segment = '{c}') AS {c}" for c in ("online", "public", "retail", "wholesale")) + " FROM clients GROUP BY 1",
    "incremental_index": f"{CHUNKS} SELECT doc_id, id, text, CAST(CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 1 THEN 2 ELSE 1 END AS INT) AS generation FROM chunk",
    "rel_asof": """SELECT c.click_id, c.client_id, c.kind, s.sale_id, epoch_us(s.sold_at) AS sold_at FROM clicks c
      ASOF LEFT JOIN (SELECT client_id, sold_at, max(sale_id) AS sale_id FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL GROUP BY 1, 2) s ON c.client_id = s.client_id AND c.ts >= s.sold_at""",
    "rel_asof_next": """SELECT s.sale_id, s.client_id, CASE WHEN c.ts <= s.sold_at + INTERVAL 1 HOUR THEN c.click_id END AS click_id FROM sales s
      ASOF LEFT JOIN (SELECT client_id, ts, max(click_id) AS click_id FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2) c ON s.client_id = c.client_id AND s.sold_at <= c.ts""",
    "rel_interval": """SELECT s.sale_id, count(*) AS n_clicks, min(c.click_id) AS first_click FROM sales s JOIN clicks c ON s.client_id = c.client_id AND s.sold_at <= c.arrived_at AND c.ts <= s.arrived_at
      WHERE s.sold_at <= s.arrived_at AND c.ts <= c.arrived_at GROUP BY 1""",
    "rel_range": "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal BETWEEN c_acctbal - 250 AND c_acctbal + 250",
}

# Other ways to the same rows.
SQL |= {"prefilter_indexed": SQL["prefilter_topk"], "keyword_postings": SQL["keyword_overlap"]}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
