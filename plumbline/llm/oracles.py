"""DuckDB SQL for the rows of the operators that SQL can express."""

from __future__ import annotations


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Codebooks refined by one chain of CTEs a round; distances are inner products of exact doubles."""
    ctes = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
            list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""part AS (SELECT rid, k, list_slice(v, len(v) * k // {parts} + 1, len(v) * (k + 1) // {parts}) AS p
            FROM kept, range({parts}) t(k))""",
        f"book0 AS (SELECT k, rid - 1 AS e, p AS c FROM part WHERE rid <= {entries})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"""near{r} AS (SELECT rid, k, arg_min(e, ROW(d, e)) AS e, min(d) AS d FROM
            (SELECT rid, a.k, e, list_inner_product(p, p) - 2 * list_inner_product(p, c) + list_inner_product(c, c) AS d
             FROM part a JOIN book{r} b ON a.k = b.k) GROUP BY rid, k)""")
        if r < rounds:
            ctes.append(f"""book{r + 1} AS (SELECT b.k, b.e, coalesce(n.c, b.c) AS c FROM book{r} b LEFT JOIN
                (SELECT k, e, list(m ORDER BY i) AS c FROM
                    (SELECT k, e, i, floor(sum(x) / count(*)) AS m FROM
                        (SELECT a.k, n.e, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM part a JOIN near{r} n ON a.rid = n.rid AND a.k = n.k)
                     GROUP BY k, e, i) GROUP BY k, e) n ON b.k = n.k AND b.e = n.e)""")
    last = rounds
    return f"""WITH {", ".join(ctes)},
        book AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY k, e, i)) AS codebooks_sha256 FROM
            (SELECT k, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM book{last})),
        coded AS (SELECT vec_id, label, string_agg(printf('%02x', e::INT), '' ORDER BY k) AS code, sum(d)::BIGINT AS error
            FROM near{last} JOIN kept USING (rid) GROUP BY rid, vec_id, label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, book"""


def repeats(length: int = 100, block: int = 1000) -> str:
    """All windows as hex, numbered by digest; spans of repeated ones merged; what is left hashed."""
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        blocks AS (SELECT doc_id, n, b * {block} AS base, substr(x, 2 * b * {block} + 1, 2 * ({block} + {length} - 1)) AS x
            FROM (SELECT *, unnest(range(0, (n - {length}) // {block} + 1)) AS b FROM d WHERE n >= {length})),
        windows AS (SELECT doc_id, base + i AS p, sha256(substr(x, 2 * i + 1, 2 * {length})) AS w
            FROM (SELECT *, unnest(range(0, least({block}, n - {length} + 1 - base))) AS i FROM blocks)),
        again AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1),
        marked AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {length}, true) AS fresh FROM again),
        runs AS (SELECT doc_id, min(p) AS a, max(p) + {length} AS b FROM
            (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM marked) GROUP BY doc_id, r),
        gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
            UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN runs ON d.doc_id = runs.doc_id GROUP BY d.doc_id),
        rest AS (SELECT doc_id, string_agg(substr(x, (2 * gaps.a + 1)::BIGINT, (2 * (gaps.b - gaps.a))::BIGINT), '' ORDER BY gaps.a, gaps.b) AS x FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
        gone AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(rest.x)) AS kept_sha256
        FROM d JOIN rest USING (doc_id) LEFT JOIN gone USING (doc_id)"""


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode(({x})::VARCHAR))::VARCHAR || ':' || ({x})::VARCHAR, '-')"


def merkle(every: int = 7) -> str:
    """Trees by recursion, siblings joined by coordinates, proofs folded over lists; crc32 bit by bit."""
    leaf = "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text"))) + ")"
    bad = "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars + 1", "text"))) + ")"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, s: xor(r // 2, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: {byte}), 4294967295)"
    up = """SELECT g, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY idx)) FROM {t} WHERE n > 1
        GROUP BY g, level, idx // 2, n"""
    step = "CASE WHEN s.node IS NULL THEN 'N' WHEN (pos >> l) % 2 = 1 THEN 'L' || s.node ELSE 'R' || s.node END"
    steps = """SELECT u.g, u.pos, list({step} ORDER BY l) AS steps FROM
        (SELECT g, pos, unnest(range(0, ceil(log2(n))::BIGINT)) AS l FROM {u}) u
        LEFT JOIN {t} s ON s.g = u.g AND s.level = l AND s.idx = xor(pos >> l, 1) GROUP BY u.g, u.pos"""
    return f"""WITH RECURSIVE leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '-') AS g, {leaf} AS leaf,
            CASE WHEN {crc} % {every} = 0 AND n_chars IS NOT NULL THEN {bad} END AS bad,
            row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents),
        tree(g, level, idx, n, node) AS (SELECT g, 0::BIGINT, pos, n, leaf FROM leaves UNION ALL {up.format(t="tree")}),
        subs AS MATERIALIZED (SELECT 'top' AS g, g AS name, node, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
        top(g, level, idx, n, node) AS (SELECT g, 0::BIGINT, pos, n, node FROM subs UNION ALL {up.format(t="top")}),
        low AS ({steps.format(step=step, u="leaves", t="tree")}),
        high AS ({steps.format(step=step, u="subs", t="top")}),
        paths AS (SELECT doc_id, leaf, coalesce(bad, leaf) AS shown, s.node AS subroot, (SELECT node FROM top WHERE n = 1) AS root,
            list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
            FROM leaves x JOIN subs s ON s.name = x.g LEFT JOIN low ON low.g = x.g AND low.pos = x.pos LEFT JOIN high ON high.pos = s.pos),
        folded AS (SELECT *, list_reduce(list_prepend(shown, steps), lambda a, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || a WHEN 'R' THEN a || s[2:] ELSE a END)) AS folded_root FROM paths)
        SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


def shard_facts(shards: int = 24) -> str:
    return f"""WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT s::INT AS shard, (n - s + {shards - 1}) // {shards} AS k FROM n, range({shards}) t(s))
        SELECT shard, 'rows' AS law, k AS rows, 0::BIGINT AS first_slot, k - 1 AS last_slot, k AS slots FROM s WHERE k > 0"""


DOCUMENT_SIZES = "SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 8)::BIGINT AS size, true AS no_grown_shard FROM documents"

_ASSIGN = """(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRET_BASE = f"""SELECT doc_id, len(list_filter(regexp_extract_all(t, '{_ASSIGN}', 2), lambda x: length(x) >= 6))::BIGINT AS n_assign,
    len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))::BIGINT AS n_access,
    len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24))::BIGINT AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

_WORD = "[^\\x20\\x09-\\x0D]+"
QUALITY_BASE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    l AS (SELECT doc_id, sum(n - 1) AS dup FROM (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY ALL) GROUP BY doc_id),
    g AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
    r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
    c AS (SELECT doc_id, count(DISTINCT p) AS words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
    b AS (SELECT doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols FROM d)
    SELECT b.doc_id, n_words, coalesce(chars, 0)::BIGINT AS word_chars, n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(words, 0)::BIGINT AS n_repeat_words,
        n_words < 50 OR 100 * coalesce(words, 0) > 50 * n_words AS base_failed, false AS failed_but_kept FROM b LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)"""

FINGERPRINT_CLASSES = "SELECT count(*) AS rows, 0::BIGINT AS wrongly_named FROM documents"


def all_sql() -> dict[str, str]:
    return {
        "op11_vector_codes": vector_codes(), "op12_repeated_bytes": repeats(), "op13_merkle_manifest": merkle(),
        "shard_facts": shard_facts(), "document_sizes": DOCUMENT_SIZES, "secret_base_counts": SECRET_BASE, "quality_base_columns": QUALITY_BASE, "fingerprint_classes": FINGERPRINT_CLASSES,
    }
