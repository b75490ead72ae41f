"""SQL for DuckDB that gives the rows of the queries which SQL can express.

The others (5, 8, 9, 10, 12 and the pipeline) rest on ciphers, fitted models or file formats; tests hold them
against brute force, exact round trips and held-out labels.
"""

from __future__ import annotations

from . import mixing, secret_scan

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWERED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_DOCUMENTS = "SELECT row_number() OVER () AS r, doc_id, {0} AS w FROM documents"


def _secrets() -> str:
    """Places of a rule's matches: what stands between them and they themselves, summed up."""
    arms = []
    for rank, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern
        if pattern.startswith("(?a:(?i:"):  # both cases of ASCII letters only
            head, _, tail = pattern.removeprefix("(?a:(?i:").partition(")))")
            pattern = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + ")" * (head.count("(") - head.count(")")) + tail
        text = pattern.replace("'", "''")
        arms.append(
            f"SELECT r, doc_id, '{rule.kind}' AS kind, {rank} AS rank, unnest(range(1, len(m) + 1)) AS i, m, parts, sized FROM (SELECT r, doc_id, regexp_extract_all(t, '{text}') AS m, regexp_split_to_array(t, '{text}') AS parts, "
            f"regexp_extract_all(t, '{text}', {rule.group}) AS sized FROM d) WHERE len(m) > 0 AND {rule.least} >= 0"
        )
    least = " ".join(f"WHEN {rank} THEN {rule.least}" for rank, rule in enumerate(secret_scan.RULES))
    base = len(secret_scan.BASE)
    joined = "coalesce(string_agg(concat(kind, ':', s, ':', s + length(m[i])), ',' ORDER BY s, rank){0}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(arms)}),
placed AS (SELECT *, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM found
    WHERE length(sized[i]) >= CASE rank {least} END)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in secret_scan.BASE)},
    sha256({joined.format(f" FILTER (rank < {base})")}) AS base_sha256, {joined.format(f" FILTER (rank < {len(secret_scan.RULES)})")} AS spans
FROM d LEFT JOIN placed USING (r) GROUP BY d.r, d.doc_id"""


def _mix() -> str:
    """The level at which capped and uncapped targets use up the share, found on sources sorted by cap and weight."""
    weight = f"CAST(list_extract([{', '.join(map(str, mixing.WEIGHTS))}], CAST(place % {len(mixing.WEIGHTS)} + 1 AS BIGINT)) AS DOUBLE)"
    kinds = []
    for k, line in enumerate(mixing.SCHEDULES):
        done, pieces = 0.0, []
        for (t0, w0), (t1, w1) in zip(line, line[1:]):
            pieces.append((done, t0, w0, (w1 - w0) / (t1 - t0)))
            done += (t1 - t0) * (w0 + w1) / 2
        arms = " ".join(f"WHEN {{0}} * {done} - {a} >= 0 THEN {t0} + 2 * ({{0}} * {done} - {a}) / ({w0} + sqrt(greatest(0, {w0 * w0} + {2 * slope} * ({{0}} * {done} - {a}))))" for a, t0, w0, slope in reversed(pieces))
        kinds.append(f"WHEN {k} THEN CASE {arms} END")
    time = f"round(least(1.0, CASE kind {' '.join(kinds)} END), 9)"
    return f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size FROM documents),
k AS (SELECT *, md5(concat('{mixing.SEED}|', coalesce(CAST(doc_id AS VARCHAR), '-'), '|', coalesce(source, '-'), '|', size)) AS h FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, place % {len(mixing.WEIGHTS)} AS kind, {weight} AS weight, 2.0 * source_size AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS caps, coalesce(sum(weight) OVER before, 0) AS weights, (SELECT 1.5 * sum(source_size) FROM s) AS total, (SELECT sum(weight) FROM w) AS every
    FROM w WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(first((total - caps) / (every - weights) ORDER BY cap / weight, place) FILTER (cap / weight >= (total - caps) / (every - weights)), 1e300) AS level FROM o),
t AS (SELECT source, kind, source_size, least(cap, weight * level) AS target FROM w, l),
p AS (SELECT k.*, t.kind, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY h, doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS supply FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, greatest(0, least(size, goal - supply)) AS once, greatest(0, least(size, goal - supply - source_size)) AS twice FROM p)
SELECT doc_id, size, source_size, round(target, 6) AS target, once + twice AS taken, CASE WHEN once > 0 THEN {time.format("(supply / target)")} END AS position,
    CASE WHEN twice > 0 THEN {time.format("((supply + source_size) / target)")} END AS repeat_position FROM u"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
top AS (SELECT t, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY t)
SELECT page_id, n AS payload_bytes, sha1(p.t) AS payload_digest,
    CASE WHEN keeper IS NOT NULL AND (page_id IS NULL OR page_id < keeper) THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN keeper IS NOT NULL AND (page_id IS NULL OR page_id < keeper) THEN keeper END AS refers_to
FROM p LEFT JOIN top USING (t)"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS ({_DOCUMENTS.format(_WORDS.format(_LOWERED))}),
i AS (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS g FROM i),
n AS (SELECT r, count(*)::BIGINT AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON a = x.r JOIN n y ON b = y.r WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (r) JOIN (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON b = r GROUP BY a) m ON m.a = d.r"""

_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATION = f"""
WITH d AS ({_DOCUMENTS.format(f"regexp_extract_all({_LOWERED}, '{_LETTERS}')")}),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWERED}, '{_LETTERS}') AS v FROM benchmark),
bi AS (SELECT item, v, least(13, len(v)) AS n, unnest(range(1, len(v) - least(13, len(v)) + 2)) AS i FROM b WHERE len(v) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(v[i:i + n - 1], ' ') AS g FROM bi),
di AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
h AS (SELECT r, i, di.n, item FROM di JOIN bw ON di.n = bw.n AND array_to_string(w[i:i + di.n - 1], ' ') = g),
pos AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)"""

SUBSTRINGS = f"""
WITH d AS ({_DOCUMENTS.format(_WORDS.format("coalesce(text, '')"))}),
i AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM i),
s AS (SELECT r, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, list(j) AS gone FROM (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM s) GROUP BY r),
x AS (SELECT r, doc_id, len(w)::BIGINT AS n, coalesce(len(gone), 0)::BIGINT AS m, list_filter(w, lambda x, j: NOT list_contains(coalesce(gone, []), j)) AS kept FROM d LEFT JOIN g USING (r))
SELECT doc_id, n AS n_words, m AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM x"""


def _usable(size: str) -> str:
    """Rows of embeddings whose vector has no null or non-finite component, with a number of their own."""
    return f"SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _floor(total: str, n: str) -> str:
    """Whole-number division that goes down, of negative numbers too."""
    rest = f"((({total}) % {n} + {n}) % {n})"
    return f"CAST((({total}) - {rest}) // {n} AS BIGINT)"


def _clusters(k: int = 16, rounds: int = 3) -> str:
    steps = [f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS k, v FROM (SELECT sha256(concat('1:', vec_id)) AS h, v FROM x ORDER BY h, v LIMIT {k}))"]
    for t in range(rounds + 1):
        distance = "CAST(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS BIGINT)"
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, vec_id, v, k, d FROM (SELECT x.r, x.vec_id, x.v, c.k, {distance} AS d FROM x CROSS JOIN c{t} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if t < rounds:
            mean = _floor("sum(v[i])::BIGINT", "count(*)")
            steps.append(
                f"m{t} AS MATERIALIZED (SELECT k, list(m ORDER BY i) AS v FROM (SELECT k, i, {mean} AS m FROM (SELECT k, v, unnest(range(1, 65)) AS i FROM a{t}) GROUP BY k, i) GROUP BY k), "
                f"c{t + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{t} c LEFT JOIN m{t} m ON m.k = c.k)"
            )
    return f"""
WITH x AS MATERIALIZED (SELECT r, vec_id, list_transform(embedding, lambda y: CAST(floor(64 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM ({_usable("len(embedding) = 64")})),
{", ".join(steps)}
SELECT vec_id, a.k AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k"""


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, size: int = 64) -> str:
    width = size // parts
    distance = f"CAST(list_sum(list_transform(range(1, {width + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS BIGINT)"
    steps = [f"c0 AS MATERIALIZED (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INTEGER) AS k, v FROM x WHERE r IN (SELECT r FROM n ORDER BY vec_id LIMIT {entries}))"]
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT x.r, x.p, x.v, y.k, y.d FROM x JOIN (SELECT r, p, min(d) AS d, arg_min(k, d * 1000 + k) AS k FROM (SELECT x.r, x.p, c.k, {distance} AS d FROM x JOIN c{t} c ON c.p = x.p) GROUP BY r, p) y ON y.r = x.r AND y.p = x.p)")
        if t < rounds:
            mean = _floor("sum(v[i])::BIGINT", "count(*)")
            steps.append(
                f"m{t} AS MATERIALIZED (SELECT p, k, list(m ORDER BY i) AS v FROM (SELECT p, k, i, {mean} AS m FROM (SELECT p, k, v, unnest(range(1, {width + 1})) AS i FROM a{t}) GROUP BY p, k, i) GROUP BY p, k), "
                f"c{t + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(m.v, c.v) AS v FROM c{t} c LEFT JOIN m{t} m ON m.p = c.p AND m.k = c.k)"
            )
    digits = "concat(substr('0123456789abcdef', k // 16 + 1, 1), substr('0123456789abcdef', k % 16 + 1, 1))"
    return f"""
WITH n AS MATERIALIZED (SELECT r, vec_id, label, list_transform(embedding, lambda y: CAST(floor({scale} * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM ({_usable("TRUE")})),
x AS MATERIALIZED (SELECT r, vec_id, p, v[p * {width} + 1:(p + 1) * {width}] AS v FROM (SELECT r, vec_id, v, unnest(range({parts})) AS p FROM n)),
{", ".join(steps)},
coded AS (SELECT r, string_agg({digits}, '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT n.vec_id, code, error, (sum(error) OVER (PARTITION BY n.label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN n ON n.r = coded.r"""


SQL: dict[str, str] = {
    "op1_secret_scan": _secrets(),
    "op2_source_mixing": _mix(),
    "op3_warc": WARC,
    "op4_ngram_join": NGRAM_JOIN,
    "op6_benchmark_decontamination": DECONTAMINATION,
    "op7_substring_dedup": SUBSTRINGS,
    "op11_centroid_clusters": _clusters(),
    "op13_vector_codes": _codes(),
}
