"""DuckDB forms of the operators that SQL can express."""

from __future__ import annotations

from millrace.llm import license_join
from millrace.llm.suffix_dedup import DEPTH

SUFFIX_DEDUP = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, h, strlen(h) // 2 AS n, unnest(range(0, strlen(h) // 2, 512)) AS o FROM d),
z AS (SELECT doc_id, n, o, substr(h, 2 * o + 1, {2 * (512 + DEPTH - 1)}) AS piece FROM q),
p AS (SELECT doc_id, n, o, piece, unnest(range(least(512, n - o))) AS i FROM z),
w AS (SELECT doc_id, o + i AS pos, substr(piece, 2 * i + 1, 2) AS b, CASE WHEN o + i + {DEPTH} <= n THEN substr(piece, 2 * i + 1, {2 * DEPTH}) END AS s FROM p),
f AS (SELECT s, min(doc_id) AS first_doc FROM w WHERE s IS NOT NULL GROUP BY s),
r AS (SELECT w.doc_id, w.pos, w.b, coalesce(first_doc < w.doc_id, false) AS hit FROM w LEFT JOIN f ON w.s = f.s),
c AS (SELECT doc_id, pos, b, max(hit::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {DEPTH - 1} PRECEDING AND CURRENT ROW) = 1 AS cut FROM r),
e AS (SELECT *, lag(cut, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM c),
g AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE cut) AS n_removed, count(*) FILTER (WHERE cut AND NOT prev) AS n_spans,
  string_agg(b, '' ORDER BY pos) FILTER (WHERE NOT cut) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def _license_sql() -> str:
    pattern = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    starts = ", ".join(
        "list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split())) + ")" for phrase in license_join.PHRASES
    )
    labels = ", ".join(f"'{v}'" for v in license_join.PHRASES.values())
    templates = ", ".join(f"('{label}', '{text}', '{naming}')" for label, text, naming in license_join.TEMPLATES)
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT doc_id, low, regexp_extract_all(low, {pattern}) AS w FROM d),
s AS (SELECT doc_id, len(w) AS n_words, [{starts}] AS s FROM w),
b AS (SELECT doc_id, n_words, flatten(s) AS places, list_sort(list_distinct(list_filter(list_transform(range(len(s)), lambda k: CASE WHEN len(s[k + 1]) > 0 THEN [{labels}][k + 1] END), lambda x: x IS NOT NULL))) AS base FROM s),
t AS (SELECT label, list_distinct(string_split(text, ' ')) AS words, string_split(naming, ' ') AS naming FROM (VALUES {templates}) AS v(label, text, naming)),
o AS (SELECT doc_id, w, unnest(range(0, len(w), {license_join.STEP})) AS o FROM w),
l AS (SELECT doc_id, list_distinct(w[o + 1 : o + {license_join.SPAN}]) AS own FROM o),
m AS (SELECT doc_id, label, len(list_intersect(own, words)) / len(words) AS held FROM l JOIN t ON list_has_all(own, naming)),
f AS (SELECT doc_id, list(DISTINCT label) AS found, max(held) AS held FROM m WHERE held >= {license_join.LEAST} - 1e-9 GROUP BY doc_id)
SELECT b.doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
  greatest(CASE WHEN len(places) > 0 THEN 1.0 ELSE 0.0 END, coalesce(held, 0.0))::DOUBLE AS score
FROM b LEFT JOIN f ON b.doc_id = f.doc_id
"""


LICENSES = _license_sql()


COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
p AS (SELECT lang, unnest(string_split_regex(low, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(greatest(len(w) - k + 1, 0)), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 100),
s AS (SELECT DISTINCT lang, array_to_string(w[i + 1 : i + m], ' ') AS phrase, a FROM (SELECT *, unnest(range(2, k)) AS m FROM c) , LATERAL (SELECT unnest(range(k - m + 1)) AS i)),
t AS (SELECT lang, phrase, max(a) AS longest FROM s GROUP BY lang, phrase),
x AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
y AS (SELECT x.lang, x.phrase, x.a, cut, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * x.a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM x JOIN n ON x.lang = n.lang JOIN f AS l ON l.lang = x.lang AND l.phrase = array_to_string(w[1 : cut], ' ') JOIN f AS r ON r.lang = x.lang AND r.phrase = array_to_string(w[cut + 1 :], ' ')),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM y),
o AS (SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, z.a DESC, z.phrase) AS rank FROM z LEFT JOIN t ON z.lang = t.lang AND z.phrase = t.phrase WHERE nth = 1 AND NOT coalesce(longest >= z.a, false))
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""


LEXICAL = r"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT place, doc_id, w, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM e),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item, item_id, term, count(*) AS k FROM (SELECT item, item_id, unnest(w) AS term FROM i) GROUP BY item, item_id, term),
t AS (SELECT place, doc_id, n, term, count(*) AS tf FROM (SELECT place, doc_id, n, unnest(w) AS term FROM e) WHERE term IN (SELECT term FROM q) GROUP BY place, doc_id, n, term),
f AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY term),
x AS (SELECT item, item_id, place, doc_id, sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length)))) AS score
  FROM q JOIN f USING (term) JOIN t USING (term), s GROUP BY item, item_id, place, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM r WHERE rank <= 10
"""
