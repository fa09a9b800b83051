"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations


def _url_filter() -> str:
    levels, prev = [], "(SELECT g, 1.0::DOUBLE / 32 AS pa, 1.0::DOUBLE / 32 AS pr FROM wanted)"
    for k in range(4):
        tail = f"substr(g, {4 - k}, {k + 1})"
        ctx = f"substr(g, {4 - k}, {k})" if k else "''"
        levels.append(f"""
t{k} AS (SELECT {tail} AS t, sum(na) AS na, sum(nr) AS nr FROM counts GROUP BY 1),
c{k} AS (SELECT {'substr(t, 1, %d)' % k if k else "''"} AS c, sum(na) AS ca, count(*) FILTER (WHERE na > 0) AS ta,
                sum(nr) AS cr, count(*) FILTER (WHERE nr > 0) AS tr FROM t{k} GROUP BY 1),
m{k} AS (SELECT m.g,
    CASE WHEN c.ca > 0 THEN (coalesce(t.na, 0) + c.ta * m.pa) / (c.ca + c.ta) ELSE m.pa END AS pa,
    CASE WHEN c.cr > 0 THEN (coalesce(t.nr, 0) + c.tr * m.pr) / (c.cr + c.tr) ELSE m.pr END AS pr
  FROM {prev} m LEFT JOIN t{k} t ON t.t = {tail.replace('(g', '(m.g')}
                LEFT JOIN c{k} c ON c.c = {ctx.replace('(g', '(m.g')}),""")
        prev = f"m{k}"
    return f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
base AS (
  SELECT page_id, url, lower(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)) AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM base),
judged AS (
  SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS v FROM ruled),
urls AS (
  SELECT coalesce(url, '') AS url, CASE min(v) WHEN 'allow' THEN 1 WHEN 'block' THEN 0 END AS label,
         '^^^' || regexp_replace(regexp_replace(lower(coalesce(url, '')), '[0-9]', '0', 'g'), '[^a-z0./\\-]', '?', 'g') || '$' AS sym,
         substr(md5(coalesce(url, '')), 1, 1) < '8' AS fits
  FROM judged GROUP BY 1),
cut_up AS (SELECT url, label, fits, unnest(list_transform(range(1, length(sym) - 2), lambda i: substr(sym, i, 4))) AS g FROM urls),
counts AS (SELECT g, sum(label) AS na, sum(1 - label) AS nr FROM cut_up WHERE label IS NOT NULL AND fits GROUP BY g),
wanted AS (SELECT DISTINCT g FROM cut_up WHERE label IS NULL OR NOT fits),
{''.join(levels)}
scored AS (SELECT url, label, avg(ln(pa / pr)) AS score FROM cut_up JOIN m3 USING (g)
           WHERE label IS NULL OR NOT fits GROUP BY url, label),
bins AS (SELECT CAST(floor(least(greatest(score, -8.0::DOUBLE), 8.0::DOUBLE) / 0.01::DOUBLE) AS INT) AS b, sum(label) AS a, sum(1 - label) AS r
         FROM scored WHERE label IS NOT NULL GROUP BY 1),
run AS (SELECT b, sum(a) OVER w - a AS below_a, sum(r) OVER w - r AS below_r, sum(a) OVER () AS ta, sum(r) OVER () AS tr
        FROM bins WINDOW w AS (ORDER BY b)),
err AS (SELECT b, round(below_a::DOUBLE / ta + (tr - below_r)::DOUBLE / tr, 12) AS e FROM run WHERE ta > 0 AND tr > 0),
cut AS (SELECT coalesce((SELECT b * 0.01::DOUBLE FROM err ORDER BY e, b LIMIT 1), 0.0) AS cut)
SELECT j.page_id, j.host, j.path, j.rule,
       CASE WHEN j.v IS NOT NULL THEN j.v WHEN s.score >= (SELECT cut FROM cut) THEN 'allow' ELSE 'block' END AS verdict
FROM judged j LEFT JOIN scored s ON s.url = coalesce(j.url, '') AND j.v IS NULL
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, half a byte at a time."""
    table = []
    for v in range(16):
        for _ in range(4):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        table.append(v)
    half = "xor(({0}) >> 4, list_extract(" + f"{table}::BIGINT[]" + ", (({0}) & 15) + 1))"
    step = half.format(half.format("xor(c, b)"))
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: unicode(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


def _merkle(levels: int = 6, upper: int = 3) -> str:
    """Trees of up to 16 ** levels leaves a source and 16 ** upper sources."""
    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(
            f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
            for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(n: str, count: int) -> str:
        return "".join(f"""
{n}r{k} AS (SELECT src, pos // 16 AS grp, any_value(cnt) AS cnt, string_agg(h, '' ORDER BY pos) AS run FROM {n}{k} WHERE cnt > 1 GROUP BY ALL),
{n}{k + 1} AS (SELECT src, grp AS pos, sha256(run) AS h, (cnt + 15) // 16 AS cnt FROM {n}r{k}
        UNION ALL SELECT src, pos, h, cnt FROM {n}{k} WHERE cnt = 1),""" for k in range(count))

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps, at = [], 0
    for n, count, src, pos in (("n", levels, "p.src", "p.pos"), ("u", upper, "0", "p.src")):
        for k in range(count):
            place = f"({pos} // {16 ** k} % 16 * 64)::INT"
            rest = f"substr(r.run, {place} + 65)"
            steps.append(f"""
p{at + 1} AS (SELECT p.src, p.pos, p.doc_id, p.leaf,
    CASE WHEN r.run IS NULL THEN p.f ELSE sha256(left(r.run, {place}) || p.f || {rest}) END AS f,
    CASE WHEN r.run IS NULL THEN p.sib ELSE p.sib || left(r.run, {place}) || {rest} END AS sib
  FROM p{at} p LEFT JOIN {n}r{k} r ON r.src = {src} AND r.grp = {pos} // {16 ** (k + 1)}),""")
            at += 1
    return f"""
WITH base AS (
  SELECT doc_id, source, {leaf('text')} AS leaf,
         CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS claimed FROM documents),
l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, count(*) OVER (PARTITION BY source) AS cnt,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM base),
n0 AS (SELECT src, pos, leaf AS h, cnt FROM l),{tree('n', levels)}
u0 AS (SELECT 0 AS src, src AS pos, h, count(*) OVER () AS cnt FROM n{levels}),{tree('u', upper)}
p0 AS (SELECT src, pos, doc_id, leaf, claimed AS f, '' AS sib FROM l),{''.join(steps)}
found AS (SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM u{upper}) AS root, sha256(p.sib) AS proof_sha256, p.f AS folded_root
          FROM p{at} p JOIN n{levels} s ON s.src = p.src)
SELECT *, folded_root = root AS verified FROM found
"""


def _structure() -> str:
    """The cheapest edits from the last row to the first, as least (cost,
    audit) from each state: 0 start, 1 after system, 2 user, 3 assistant.
    Insertions are left out: deleting the partner of an inserted row is cheaper."""
    white = "[\\x20\\x09-\\x0D]"
    stay = "(CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END)"

    def state(q: int) -> str:
        step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q]
        options = [f"{{'c': d.b{q}.c + 2, 's': 'D' || d.b{q}.s}}"]
        for initial, to in step.items():
            ok = "r.fault IN ('blank', 'duplicate')"
            options.append(f"CASE WHEN NOT {ok} AND r.i = '{initial}' THEN {{'c': d.b{to}.c + {stay}, 's': 'K' || d.b{to}.s}} END")
            if initial != "s":
                options.append(f"CASE WHEN NOT {ok} THEN {{'c': d.b{to}.c + 1 + {stay}, 's': 'R' || d.b{to}.s}} END")
        return f"list_min([{', '.join(options)}]) AS b{q}"

    none = "{'c': 1000000000::BIGINT, 's': ''}"
    clean = "{'c': 0::BIGINT, 's': ''}"
    return f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations),
rows AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM d WHERE k <> 0),
placed AS (SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM rows),
faults AS (
  SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i AS pair, CASE
    WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?]{white}*$') THEN 'truncated' ELSE 'none' END AS fault FROM placed),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(n) AS n,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
dp AS (
  SELECT conv_id, n, {clean} AS b0, {none} AS b1, {none} AS b2, {clean} AS b3 FROM stats
  UNION ALL
  SELECT d.conv_id, d.n - 1, {state(0)}, {state(1)}, {state(2)}, {state(3)}
  FROM dp d JOIN faults r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.n = d.n),
ways AS (SELECT conv_id, b0.c AS cost, b0.s AS audit FROM dp WHERE n = 0),
edits AS (SELECT f.*, substr(w.audit, f.n::INT, 1) AS e FROM faults f JOIN ways w ON w.conv_id IS NOT DISTINCT FROM f.conv_id),
stays AS (SELECT *, e = 'K' AND i = 's' AS lead, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS k,
                 max(CASE WHEN e = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM edits WHERE e <> 'D'),
texts AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (k - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
                                    chr(10) ORDER BY n)) AS h FROM stays GROUP BY conv_id)
SELECT a.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
       coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, coalesce(w.cost, 0) AS cost,
       coalesce(w.audit, '') AS audit, coalesce(t.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN ways w ON w.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
"""


ORACLE = {"op5_url_filter": _url_filter(), "op12_merkle_manifest": _merkle(),
          "op13_structure_repair": _structure()}
