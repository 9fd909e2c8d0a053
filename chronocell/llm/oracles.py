"""DuckDB SQL for the queries that SQL can express, written from the definitions and not from the operators."""

from __future__ import annotations

from .fingerprints import LEAF
from .licenses import PHRASES, TEMPLATES, WORDS
from .secrets import BASE_RULES, RULES

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def crc32(text: str) -> str:
    """Bit by bit: each character is xored in and shifted out over eight steps, the first of which brings it in."""
    steps = f"list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''), lambda ch: [unicode(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0])))"
    one = "CASE WHEN xor(c, x) % 2 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END"
    return f"xor(list_reduce({steps}, lambda c, x: {one}), 4294967295)"


# ---- op2: tokens and base scores -----------------------------------------------------------------

ORACLES["token_base_scores"] = f"""
WITH d AS (SELECT doc_id, {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 2 AS held_out,
    list_append(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}'), chr(10)) AS tokens FROM documents),
t AS (SELECT doc_id, held_out, unnest(tokens) AS token FROM d),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
    round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 6) AS base_score
FROM t LEFT JOIN c USING (token), s GROUP BY 1, 2"""

# ---- op3: sizes and targets ----------------------------------------------------------------------

ORACLES["mix_targets"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
level(round, x) AS (SELECT 0, (SELECT sum(source_size) / sum(w) FROM s)::DOUBLE
    UNION ALL SELECT round + 1, ((SELECT sum(source_size) FROM s) - (SELECT sum(3 * source_size) FROM s WHERE w * x > 3 * source_size)) / (SELECT sum(w) FROM s WHERE w * x <= 3 * source_size)
    FROM level WHERE round < 100 AND EXISTS (SELECT 1 FROM s WHERE w * x > 3 * source_size) AND EXISTS (SELECT 1 FROM s WHERE w * x <= 3 * source_size)
        AND (round = 0 OR ((SELECT sum(source_size) FROM s) - (SELECT sum(3 * source_size) FROM s WHERE w * x > 3 * source_size)) / (SELECT sum(w) FROM s WHERE w * x <= 3 * source_size) > x)),
last AS (SELECT max(x) AS x FROM level)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(least(3 * source_size, w * x), 6) AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, last"""

# ---- op5 -----------------------------------------------------------------------------------------

ORACLES["op5_setsketch_neardup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS shingles FROM d),
one AS (SELECT min(doc_id) AS doc_id, list_sort(shingles) AS shingles, len(any_value(shingles)) AS n FROM sets WHERE len(shingles) > 0 GROUP BY list_sort(shingles)),
each AS (SELECT doc_id, n, unnest(shingles) AS shingle FROM one),
seen AS (SELECT shingle, count(*) AS held FROM each GROUP BY 1),
-- of a set in order of rarity, all but the last 85 % less one: two sets that meet the threshold share one of these
ranked AS (SELECT doc_id, n, shingle, row_number() OVER (PARTITION BY doc_id ORDER BY held, shingle) AS nth FROM each JOIN seen USING (shingle)),
prefix AS (SELECT doc_id, n, shingle FROM ranked WHERE nth <= n - ceil(0.85 * n) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM pairs JOIN one x ON x.doc_id = a JOIN one y ON y.doc_id = b
    WHERE 100 * len(list_intersect(x.shingles, y.shingles)) >= 85 * (x.n + y.n - len(list_intersect(x.shingles, y.shingles)))),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
roots AS (SELECT a AS doc_id, least(a, min(b)) AS root FROM reach GROUP BY a),
named AS (SELECT list_sort(shingles) AS shingles, coalesce(root, doc_id) AS root FROM one LEFT JOIN roots USING (doc_id))
SELECT s.doc_id, len(s.shingles) AS n_shingles, coalesce(n.root, s.doc_id) AS component_id, coalesce(n.root, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN named n ON list_sort(s.shingles) = n.shingles"""

# ---- op7 -----------------------------------------------------------------------------------------


def _tree(text: str, name: str) -> str:
    leaf = "substring(sha256('l' || x), 1, 32)"
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, {quoted(LEAF)}), lambda x: {leaf}))) AS {name}_runs"


def _nodes(name: str) -> str:
    return f"list_transform({name}_runs, lambda s: list_transform(s, lambda p: sha256('p' || array_to_string(p, '')))) AS {name}_paragraphs"


def _sections(name: str) -> str:
    return f"list_transform({name}_paragraphs, lambda s: sha256('s' || array_to_string(s, ''))) AS {name}_sections, list_transform(flatten(flatten({name}_runs)), lambda x: substring(x, 1, 8)) AS {name}_leaves"


def _fingerprint(name: str) -> str:
    return f"""{name}_root || ':' || array_to_string(list_transform({name}_sections, lambda s: substring(s, 1, 16)), '.') || ':'
    || array_to_string(list_transform({name}_paragraphs, lambda s: array_to_string(list_transform(s, lambda p: substring(p, 1, 8)), '')), '.') || ':' || array_to_string({name}_leaves, '')"""


def _near(a: str, b: str) -> str:
    x, y = f"len(list_distinct({a}_leaves))", f"len(list_distinct({b}_leaves))"
    return f"CASE WHEN {a}_root = {b}_root THEN 1.0 WHEN {x} + {y} = 0 THEN 0.0 ELSE least(2.0 * len(list_intersect(list_distinct({a}_leaves), list_distinct({b}_leaves))) / ({x} + {y}), 0.999999) END"


_TREES = ("own", "new", "next")
ORACLES["op7_merkle_fingerprints"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS own FROM documents),
n AS (SELECT *, coalesce(lead(own) OVER (ORDER BY doc_id DESC), first_value(own) OVER (ORDER BY doc_id DESC)) AS next FROM d),
e AS (SELECT *, substring(own, 1, length(own) - length(own) // 2) || substring(next, 1, length(own) // 2) AS new FROM n),
r AS (SELECT *, {", ".join(_tree(x, x) for x in _TREES)} FROM e),
p AS (SELECT *, {", ".join(_nodes(x) for x in _TREES)} FROM r),
s AS (SELECT *, {", ".join(_sections(x) for x in _TREES)} FROM p),
t AS (SELECT *, {", ".join(f"sha256('r' || array_to_string({x}_sections, '')) AS {x}_root" for x in _TREES)} FROM s),
g AS (SELECT *, list_filter(own_sections, lambda x: NOT list_contains(new_sections, x)) AS gone, list_filter(flatten(own_paragraphs), lambda x: NOT list_contains(flatten(new_paragraphs), x)) AS lost FROM t)
SELECT doc_id, length(own) AS n_chars, sha256(new) AS edited_sha256, {_fingerprint("own")} AS fingerprint, {_fingerprint("new")} AS edited_fingerprint,
    CAST({_near("own", "new")} AS DOUBLE) AS near_edited, CAST({_near("own", "next")} AS DOUBLE) AS near_next,
    CASE WHEN own_root = new_root THEN '' ELSE array_to_string(list_filter(range(len(own_sections)), lambda i: list_contains(gone, own_sections[i + 1])), ',') END AS changed_sections,
    CASE WHEN own_root = new_root THEN '' ELSE array_to_string(flatten(list_transform(list_filter(range(len(own_sections)), lambda i: list_contains(gone, own_sections[i + 1])), lambda i:
        list_transform(list_filter(range(len(own_paragraphs[i + 1])), lambda j: list_contains(lost, own_paragraphs[i + 1][j + 1])), lambda j: i || '.' || j))), ',') END AS changed_paragraphs
FROM g"""

# ---- op8 -----------------------------------------------------------------------------------------


def _starts(phrase: str) -> str:
    words = phrase.split(" ")
    here = " AND ".join(f"words[i + {k + 1}] = {quoted(w)}" for k, w in enumerate(words))
    return f"list_filter(range(len(words) - {len(words) - 1}), lambda i: {here})"


_PLACES = ", ".join(f"{_starts(p)} AS at_{i}" for i, (_, p) in enumerate(PHRASES))
_ALL = "flatten([" + ", ".join(f"at_{i}" for i in range(len(PHRASES))) + "])"
_BASE = "list_sort(list_filter([" + ", ".join(f"CASE WHEN len(at_{i}) > 0 THEN {quoted(label)} END" for i, (label, _) in enumerate(PHRASES)) + "], lambda x: x IS NOT NULL))"
_LONGEST = max(len(t.split(" ")) for _, t in TEMPLATES)
_RULES = ", ".join(f"({i}, {quoted(label)}, list_distinct(string_split({quoted(t)}, ' ')))" for i, (label, t) in enumerate(TEMPLATES))
ORACLES["op8_license_scan"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORDS}') AS words FROM documents),
b AS (SELECT doc_id, words, {_PLACES} FROM d),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM d),
l AS (SELECT doc_id, line_no, regexp_extract_all({LOWER.format("line")}, '{WORDS}') AS w FROM raw),
k AS (SELECT doc_id, line_no, w, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS nth, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line_no) AS upto FROM l WHERE len(w) > 0),
-- a line goes on with the next ones until those hold as many words as the longest template
blocks AS (SELECT a.doc_id, a.line_no, any_value(a.w) AS alone, flatten(list(c.w ORDER BY c.nth) FILTER (c.w IS NOT NULL)) AS rest
    FROM k a LEFT JOIN k c ON c.doc_id = a.doc_id AND c.nth > a.nth AND c.nth <= a.nth + {_LONGEST} AND c.upto - len(c.w) - a.upto < {_LONGEST} GROUP BY 1, 2),
m AS (SELECT * FROM (VALUES {_RULES}) AS x(template, label, own)),
hits AS (SELECT doc_id, line_no, template, label, own, len(own) AS size, ceil(0.85 * len(own) - 1e-9) AS need, list_intersect(own, list_concat(alone, coalesce(rest, []))) AS shared,
    len(list_intersect(own, alone)) AS in_alone, len(list_intersect(own, coalesce(rest, []))) AS in_rest FROM blocks, m WHERE list_has_any(own, list_concat(alone, coalesce(rest, [])))),
met AS (SELECT *, len(shared) / size AS containment FROM hits WHERE len(shared) >= need AND (in_alone >= need OR in_rest < len(shared))),
best AS (SELECT DISTINCT doc_id, line_no, label, containment FROM met x WHERE NOT EXISTS (SELECT 1 FROM met y WHERE y.doc_id = x.doc_id AND y.line_no = x.line_no AND list_has_all(y.shared, x.shared) AND (len(y.shared) > len(x.shared) OR y.containment > x.containment))),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS top, array_to_string(list(line_no || ':' || label || ':' || round(containment, 4) ORDER BY line_no, label, containment), ',') AS blocks FROM best GROUP BY 1)
SELECT doc_id, len(words) AS n_words, len({_ALL}) AS n_base, list_min({_ALL}) AS first_word, list_max({_ALL}) AS last_word, array_to_string({_BASE}, ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat({_BASE}, coalesce(labels, [])))), ',') AS labels, CAST(CASE WHEN len({_ALL}) > 0 THEN 1.0 ELSE coalesce(top, 0) END AS DOUBLE) AS score, coalesce(blocks, '') AS blocks
FROM b LEFT JOIN found USING (doc_id)"""

# ---- op10 ----------------------------------------------------------------------------------------


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """The pieces between matches and the matches alternate, so running sums of their lengths are places."""
    return f"""SELECT doc_id, {rank} AS rank, {quoted(kind)} AS kind, CAST(sum(gap + long) OVER w - long AS BIGINT) AS first_char, CAST(sum(gap + long) OVER w AS BIGINT) AS upto, counts
    FROM (SELECT doc_id, nth, length(gaps[nth]) AS gap, length(hits[nth]) AS long, length(vals[nth]) AS counts FROM (SELECT doc_id, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS nth FROM
        (SELECT doc_id, string_split_regex(text, {quoted(pattern)}) AS gaps, regexp_extract_all(text, {quoted(pattern)}) AS hits, regexp_extract_all(text, {quoted(pattern)}, {group}) AS vals FROM d)))
    WINDOW w AS (PARTITION BY doc_id ORDER BY nth)
    QUALIFY counts >= {least}"""


def _joined(where: str) -> str:
    return f"coalesce(array_to_string(list(kind || ':' || first_char || ':' || upto ORDER BY first_char, rank, upto) FILTER ({where}), ','), '')"


ORACLES["op10_secret_ledger"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(f"SELECT * FROM ({_spans(i, *rule)})" for i, rule in enumerate(RULES))})
SELECT doc_id, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, (k, *_) in enumerate(BASE_RULES))},
    sha256({_joined(f"rank < {len(BASE_RULES)}")}) AS base_sha256, {_joined("rank IS NOT NULL")} AS spans, any_value(sha256(text)) AS sha256
FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""
