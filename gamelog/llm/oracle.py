"""SQL twins of the registered queries that SQL can express."""

from gamelog.llm import license_scan

#: Poisson replication at the default parameters: power 0.5, one epoch, seed "mix".
MIXING = """
WITH sizes AS (
    SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source
), weighed AS (
    SELECT source, size, CASE WHEN size > 0 THEN sqrt(size) ELSE 0 END AS weight FROM sizes
), rates AS (
    SELECT source, weight / sum(weight) OVER () * sum(size) OVER () / size AS rate
    FROM weighed WHERE size > 0
), terms AS (
    SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
    FROM rates, generate_series(0, 400) AS g(k)
), numbered AS (
    SELECT *, row_number() OVER () AS row_no,
        ('0x' || substr(md5('mix/count/0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(source, 'null')), 1, 13))::BIGINT
            / pow(2, 52) AS u
    FROM documents
), counted AS (
    SELECT d.row_no, count(*) AS n
    FROM numbered d JOIN terms t ON d.source IS NOT DISTINCT FROM t.source AND d.u >= t.cdf
    GROUP BY d.row_no
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INTEGER AS copy,
    md5('mix/place:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || c.copy) AS place
FROM numbered d JOIN counted n USING (row_no), generate_series(1, 1000) AS c(copy)
WHERE c.copy <= n.n
ORDER BY place, copy
"""

#: Integer inner products of the queries with all other rows; the best five of each.
TOP_K = """
WITH whole AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


#: 20-word windows that also start earlier, and what is left of each document.
WORD_WINDOWS = """
WITH split AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), starts AS (
    SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS s FROM split WHERE len(words) >= 20
), named AS (
    SELECT doc_id, s, md5(array_to_string(words[s:s + 19], ' ')) AS h FROM starts
), later AS (
    SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM named) WHERE k > 1
), gone AS (
    SELECT DISTINCT doc_id, s + o AS i FROM later, generate_series(0, 19) AS g(o)
), left_over AS (
    SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS kept, count(*) AS n
    FROM (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM split) w
    LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i
    WHERE g.i IS NULL GROUP BY w.doc_id
)
SELECT split.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN left_over USING (doc_id)
"""

#: The same for 100-byte strings, written as hexadecimal digits.
BYTE_STRINGS = """
WITH raw AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits, strlen(coalesce(text, '')) AS n FROM documents
), named AS (
    SELECT doc_id, s, md5(substr(digits, 2 * s + 1, 200)) AS h
    FROM (SELECT doc_id, digits, unnest(generate_series(0, n - 100)) AS s FROM raw WHERE n >= 100)
), later AS (
    SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM named) WHERE k > 1
), edges AS (
    SELECT *, max(s + 100) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
    FROM later
), runs AS (
    SELECT *, sum(CASE WHEN reached IS NULL OR s > reached THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run
    FROM edges
), spans AS (
    SELECT doc_id, run, min(s) AS low, max(s) + 100 AS high FROM runs GROUP BY doc_id, run
), pieces AS (
    SELECT doc_id, coalesce(lag(high) OVER w, 0) AS low, low AS high FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY low)
    UNION ALL SELECT raw.doc_id, coalesce(max(high), 0), n FROM raw LEFT JOIN spans USING (doc_id) GROUP BY raw.doc_id, n
), left_over AS (
    SELECT doc_id, string_agg(substr(digits, 2 * low + 1, 2 * (high - low)), '' ORDER BY low) AS kept
    FROM pieces JOIN raw USING (doc_id) GROUP BY doc_id
), counted AS (
    SELECT doc_id, count(*) AS n_spans, sum(high - low) AS n_removed FROM spans GROUP BY doc_id
)
SELECT raw.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
    coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM raw JOIN left_over USING (doc_id) LEFT JOIN counted USING (doc_id)
"""

#: Sets of 4-word shingles, links from 85 per cent, and what can be reached by links.
JACCARD = """
WITH RECURSIVE split AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, md5(array_to_string(words[s:s + 3], ' ')) AS h
    FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) AS s FROM split WHERE len(words) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id
        JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reached AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN reached r ON r.a = d.doc_id
GROUP BY d.doc_id
"""


#: The blocks of the article of the test pages: headings, paragraphs, bold type.
ARTICLES = """
WITH bodies AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages
), blocks AS (
    SELECT page_id, url, list_transform(string_split_regex(body, '</?p>|</?h1>|<br>'), lambda x:
        trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '</?b>', '', 'g'),
            '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS texts
    FROM bodies
), joined AS (
    SELECT page_id, url, array_to_string(list_filter(texts, lambda x: x <> ''), chr(10)) AS text FROM blocks
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM joined
"""


def _licenses() -> str:
    """Votes of word 3-grams per diagonal of every template, and what they add up to."""
    rows = [
        (gram, template, at, size, label, template in license_scan.BASE_PHRASES)
        for templates in (license_scan.BASE_PHRASES, license_scan.NOTICES)
        for gram, template, at, size in license_scan.template_positions(templates, license_scan.K)
        for label in (templates[template],)
    ]
    values = ", ".join(f"('{g}', '{t}', {at}, {size}, '{label}', {base})" for g, t, at, size, label, base in rows)
    return f"""
WITH templates(gram, template, pos, size, label, base) AS (VALUES {values}
), split AS (
    SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM documents
), grams AS (
    SELECT row_no, s - 1 AS place, array_to_string(words[s:s + 2], ' ') AS gram
    FROM (SELECT row_no, words, unnest(generate_series(1, len(words) - 2)) AS s FROM split WHERE len(words) > 2)
), lines AS (
    SELECT row_no, template, size, label, base, place - pos AS diagonal, list(DISTINCT pos) AS ats
    FROM grams JOIN templates USING (gram) GROUP BY ALL
), whole AS (
    SELECT row_no, label, diagonal FROM lines WHERE base AND len(ats) = size
), numbered AS (
    SELECT *, sum(apart) OVER (PARTITION BY row_no, template ORDER BY diagonal) AS span FROM (
        SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row_no, template ORDER BY diagonal)
            <= {license_scan.NEAR_DIAGONALS} THEN 0 ELSE 1 END AS apart
        FROM lines WHERE NOT base)
), parts AS (
    SELECT row_no, label, count(DISTINCT pos)::DOUBLE / size AS share
    FROM (SELECT row_no, label, template, size, span, unnest(ats) AS pos FROM numbered)
    GROUP BY row_no, label, template, size, span HAVING count(DISTINCT pos)::DOUBLE / size >= {license_scan.LEAST_SHARE}
), found AS (
    SELECT row_no, label, diagonal, 1.0 AS share FROM whole UNION ALL SELECT row_no, label, NULL, share FROM parts
), summed AS (
    SELECT row_no, count(diagonal) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE diagonal IS NOT NULL) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
    FROM found GROUP BY row_no
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
    last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    coalesce(score, 0)::DOUBLE AS score
FROM split LEFT JOIN summed USING (row_no)
"""


#: Links from 80 per cent, and whether a document leads its component.
NEAR_DUPLICATES = f"SELECT *, doc_id = component_id AS kept FROM ({JACCARD.replace('>= 85 *', '>= 80 *')})"


def _collocations() -> str:
    """All phrases of up to four words counted, cut at every place, and the contained ones dropped."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, list_slice(w, s, s + {k - 1}) AS p FROM (SELECT lang, w, unnest(generate_series(1, len(w) - {k - 1})) AS s FROM pieces)"
        for k in range(1, 5)
    )
    cuts = " UNION ALL ".join(f"SELECT *, {k} AS cut FROM often WHERE k > {k}" for k in range(1, 4))
    return f"""
WITH pieces AS MATERIALIZED (
    SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), often AS MATERIALIZED (
    SELECT lang, k, p, count(*) AS a FROM ({grams}) GROUP BY lang, k, p HAVING count(*) >= 30
), scored AS (
    SELECT c.lang, c.p, c.k, c.a, c.cut, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
    FROM ({cuts}) c
    JOIN often x ON x.lang = c.lang AND x.p = c.p[1:c.cut]
    JOIN often y ON y.lang = c.lang AND y.p = c.p[c.cut + 1:c.k]
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
), held AS (
    SELECT lang, p, max(a) AS most FROM (
        SELECT lang, p[1:k - 1] AS p, a FROM often WHERE k > 2 UNION ALL SELECT lang, p[2:k] AS p, a FROM often WHERE k > 2)
    GROUP BY lang, p
), kept AS (
    SELECT lowest.*, array_to_string(lowest.p, ' ') AS phrase FROM lowest LEFT JOIN held USING (lang, p)
    WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def _clusters(count: int = 40, rounds: int = 5) -> str:
    """Rounds of nearest centroids and floored means, written one after another."""
    steps = [f"""
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM whole
    ORDER BY sha256('2:' || vec_id) LIMIT {count}
)"""]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
    SELECT row_no, vec_id, v, c, d FROM (
        SELECT w.row_no, w.vec_id, w.v, m.c, list_sum(list_transform(list_zip(w.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
        FROM whole w, c{k} m)
    QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY d, c) = 1
)""")
        if k < rounds:
            steps.append(f"""
s{k} AS (
    SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS mean FROM (
        SELECT c, i, sum(x) AS s, count(*)::HUGEINT AS n
        FROM (SELECT c, unnest(v) AS x, unnest(generate_series(1, 64)) AS i FROM a{k}) GROUP BY c, i)
), m{k} AS (
    SELECT c, list(mean ORDER BY i) AS v FROM s{k} GROUP BY c
), c{k + 1} AS MATERIALIZED (
    SELECT c{k}.c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} ON m{k}.c = c{k}.c
)""")
    return f"""
WITH whole AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), {",".join(steps)}
SELECT vec_id, a{rounds}.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia,
    (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = a{rounds}.c
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_site_style_tree": ARTICLES,
        "op2_jaccard_join": JACCARD,
        "op3_source_mixing": MIXING,
        "op5_suffix_doubling": BYTE_STRINGS,
        "op6_va_file": TOP_K,
        "op7_license_scan": _licenses(),
        "op9_block_anchors": WORD_WINDOWS,
        "op11_bbit_minhash": NEAR_DUPLICATES,
        "op12_collocations": _collocations(),
        "op13_centroid_clustering": _clusters(),
    }
