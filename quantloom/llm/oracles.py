"""SQL that gives the rows of queries of this subpackage, where SQL can."""

from __future__ import annotations

from .licenses import LICENSES, PHRASES


def cluster_embeddings(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """Lloyd's rounds as common table expressions, each over all vectors and centroids."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS q FROM embeddings
            WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"v AS MATERIALIZED (SELECT r, i, q[i] AS x FROM kept, range(1, {dim + 1}) t(i))",
        f"chosen AS MATERIALIZED (SELECT q, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS j FROM kept QUALIFY j < {k})",
        f"c0 AS MATERIALIZED (SELECT j, i, q[i] AS c FROM chosen, range(1, {dim + 1}) t(i))",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT r, j, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM v JOIN c{n} USING (i) GROUP BY r, j) GROUP BY r)")
        if n < rounds:
            means = f"SELECT j, i, (s - ((s % m) + m) % m) // m AS c FROM (SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS m FROM a{n} JOIN v USING (r) GROUP BY j, i)"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT j, i, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN ({means}) m USING (j, i))")
    parts.append(f"named AS (SELECT j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY j)")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
        FROM a{rounds} JOIN named USING (j) JOIN kept USING (r)"""


def license_scan() -> str:
    """Every block that starts at a word of a template, counted in full."""
    tokens, kinds, phrases = [], [], []
    for i, t in enumerate((*PHRASES, *LICENSES)):
        kinds.append(f"({i}, '{t.label}', {t.block}, {t.needed}, {len(set(t.words))}, {len(t.must)})")
        if t.ordered:
            at = " AND ".join(f"lead(w, {k}) OVER o = '{w}'" if k else f"w = '{w}'" for k, w in enumerate(t.words))
            phrases.append(f"SELECT r, p, '{t.label}' AS label, 1.0 AS share, true AS ordered FROM (SELECT r, p, {at} AS hit FROM words WINDOW o AS (PARTITION BY r ORDER BY p)) WHERE hit")
        else:
            tokens += [f"({i}, '{w}', {w in t.must}, false)" for w in sorted(set(t.words))] + [f"({i}, '{w}', false, true)" for w in t.never]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH tokens(t, w, must, never) AS (VALUES {", ".join(tokens)}), kinds(t, label, size, needed, total, musts) AS (VALUES {", ".join(kinds)}),
        texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        words AS MATERIALIZED (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM texts),
        hits AS MATERIALIZED (SELECT r, t, p, w, must, never FROM words JOIN tokens USING (w)),
        blocks AS (SELECT a.r, a.t, a.p, count(DISTINCT b.w) FILTER (NOT b.never) AS n, count(DISTINCT b.w) FILTER (b.must) AS musts, bool_or(b.never) AS never
            FROM hits a JOIN kinds USING (t) JOIN hits b ON a.r = b.r AND a.t = b.t AND b.p >= a.p AND b.p < a.p + kinds.size WHERE NOT a.never GROUP BY a.r, a.t, a.p),
        found AS (SELECT r, p, label, CAST(n AS DOUBLE) / total AS share, false AS ordered FROM blocks JOIN kinds USING (t) WHERE n >= needed AND blocks.musts = kinds.musts AND NOT never
            UNION ALL {" UNION ALL ".join(phrases)}),
        sums AS (SELECT r, count(*) FILTER (ordered) AS n_base, min(p) FILTER (ordered) AS first_word, max(p) FILTER (ordered) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ordered) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM found GROUP BY r)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
        FROM texts LEFT JOIN sums USING (r)"""


def spelling_variants(least_length: int = 7, least_count: int = 2, errata: int = 31, times: int = 10) -> str:
    """Near words by words that are equal after a code point is left out; crc32 by its table, a byte at a time."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    digit = "(instr('0123456789ABCDEF', substr(x, {0}, 1)) - 1)"
    byte = f"16 * {digit.format('2 * i - 1')} + {digit.format('2 * i')}"
    return f"""WITH RECURSIVE tab AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
        runs AS MATERIALIZED (SELECT id, run, count(*) AS k FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {least_length} GROUP BY id, run),
        coded AS (SELECT run, k, list_transform(range(1, len(x) // 2 + 1), lambda i: {byte}) AS bytes FROM (SELECT run, k, hex(encode(id || ':' || run)) AS x FROM runs)),
        hashed AS MATERIALIZED (SELECT run, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM coded, tab),
        words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {errata} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed)
            WHERE length(word) >= {least_length} GROUP BY word HAVING sum(k) >= {least_count}),
        less AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS d FROM words, range(1, length(word) + 1) r(i)),
        longer AS (SELECT DISTINCT less.word AS a, w.word AS b FROM less JOIN words w ON w.word = less.d),
        near AS MATERIALIZED (SELECT a, b FROM longer UNION SELECT b, a FROM longer UNION SELECT x.word, y.word FROM less x JOIN less y ON x.d = y.d AND x.i = y.i AND x.word <> y.word),
        best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-w.n, b)) AS b, max(w.n) AS m FROM near JOIN words w ON w.word = near.b GROUP BY a),
        forms AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {times} * n THEN b END AS form, CASE WHEN m >= {times} * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
        walk AS (SELECT word, word AS here, 0 AS steps FROM forms UNION ALL SELECT walk.word, forms.form, steps + 1 FROM walk JOIN forms ON forms.word = walk.here WHERE forms.form IS NOT NULL)
        SELECT word, form, arg_max(here, steps) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n FROM walk JOIN forms USING (word) GROUP BY word, form"""
