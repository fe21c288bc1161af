"""DuckDB SQL for the quality rules: the same statistics, starts, concentration steps and leaning, a chain of tables.

All steps are written out; an estimate that has converged is carried on unchanged."""

from __future__ import annotations

from . import quality as q

WORD = r"[^\x20\x09-\x0D]+"


def op4_sql() -> str:
    names, floors = list(q.FLOORS), list(q.FLOORS.values())
    p = range(len(names))
    pairs = [(i, j) for i in p for j in range(i + 1)]

    def factor() -> str:
        """Columns of the triangular factor; later ones use earlier ones."""
        out = []
        for j in p:
            out.append(f"sqrt(c_{j}_{j}" + "".join(f" - l_{j}_{k} * l_{j}_{k}" for k in range(j)) + f") AS l_{j}_{j}")
            out += [f"(c_{i}_{j}" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j)) + f") / l_{j}_{j} AS l_{i}_{j}" for i in p if i > j]
        return ", ".join(out)

    def distance() -> str:
        z = [f"({x} - m_{i}" + "".join(f" - l_{i}_{k} * z_{k}" for k in range(i)) + f") / l_{i}_{i} AS z_{i}" for i, x in enumerate(names)]
        return ", ".join([*z, " + ".join(f"z_{i} * z_{i}" for i in p) + " AS d2", f"floor(log2(greatest(d2, 1e-9)) * {q.OCTAVE})::INTEGER AS bin"])

    def floor(i: int, j: int) -> str:
        return f" + {floors[i]}::DOUBLE ** 2" if i == j else ""

    def log_det() -> str:
        return " + ".join(f"2 * ln(l_{i}_{i})" for i in p) + " AS log_det"

    tables = [
        f"w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents)",
        "tri AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3))",
        "dup AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, s) > 1)",
        "cov AS (SELECT r, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) v(k) GROUP BY r)",
        rf"lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS again FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{WORD}') GROUP BY r)",
        f"""counted AS (SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{q.SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(lines.again, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  coalesce(lines.n, 0)::BIGINT AS n_lines, (length(t) - length(translate(t, '{q.CAPITALS}', '')))::BIGINT AS n_capitals FROM w LEFT JOIN cov USING (r) LEFT JOIN lines USING (r))""",
        f"""stats AS MATERIALIZED (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed, ln(greatest(word_chars, 1) / greatest(n_words, 1)) AS x_word,
  sqrt(n_symbols / greatest(word_chars, 1)) AS x_symbol, sqrt(n_dup_lines / greatest(n_lines, 1)) AS x_line, sqrt(n_repeat_words / greatest(n_words, 1)) AS x_repeat,
  sqrt(n_capitals / greatest(word_chars, 1)) AS x_capital FROM counted)""",
        f"points AS MATERIALIZED (SELECT r, struct_pack(l := lang, s := source) AS gid, {', '.join(names)} FROM stats WHERE NOT base_failed)",
        "binned AS (" + " UNION ALL ".join(f"SELECT gid, {i} AS i, floor({x} * {q.UNIT}) AS b, count(*) AS n FROM points GROUP BY ALL" for i, x in enumerate(names)) + ")",
        'ranked AS (SELECT *, sum(n) OVER (PARTITION BY gid, i ORDER BY b) AS upto, sum(n) OVER (PARTITION BY gid, i) AS "all" FROM binned)',
        "marks AS (SELECT gid, i, "
        + ", ".join(f'min((b + 0.5::DOUBLE) / {q.UNIT}) FILTER (upto >= {x} * "all") AS {n}' for n, x in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75)))
        + " FROM ranked GROUP BY gid, i)",
        "middle AS MATERIALIZED (SELECT gid, "
        + ", ".join(f"max(mid) FILTER (i = {i}) AS m_{i}, max((hi - lo) / 1.349::DOUBLE) FILTER (i = {i}) AS s_{i}" for i in p)
        + " FROM marks GROUP BY gid)",
        f"met AS (SELECT *, {', '.join(f'{x} - m_{i} AS o_{i}, ({x} - m_{i}) / greatest(s_{i}, {floors[i]}::DOUBLE) AS u_{i}' for i, x in enumerate(names))} FROM points JOIN middle USING (gid))",
        "measured AS (SELECT *, 1e-9 + " + " + ".join(f"u_{i} * u_{i}" for i in p) + " AS rr FROM met)",
        f"summed AS MATERIALIZED (SELECT gid, count(*)::DOUBLE AS n, {', '.join(f'any_value(m_{i}) AS m_{i}, any_value(s_{i}) AS s_{i}, sum(o_{i}) AS t_{i}' for i in p)}, "
        + ", ".join(f"sum(o_{i} * o_{j}) AS q_{i}_{j}, sum(u_{i} * u_{j} / rr) AS d_{i}_{j}" for i, j in pairs)
        + " FROM measured GROUP BY gid)",
        f"start AS (SELECT gid, 0 AS start, {', '.join(f'm_{i}' for i in p)}, {', '.join((f's_{i} ** 2' if i == j else '0.0::DOUBLE') + floor(i, j) + f' AS c_{i}_{j}' for i, j in pairs)} FROM middle"
        f" UNION ALL SELECT gid, 1, {', '.join(f'm_{i} + t_{i} / n' for i in p)}, {', '.join(f'q_{i}_{j} / n - t_{i} * t_{j} / (n * n)' + floor(i, j) for i, j in pairs)} FROM summed"
        f" UNION ALL SELECT gid, 2, {', '.join(f'm_{i}' for i in p)}, {', '.join(f'{len(names)} * d_{i}_{j} / n * greatest(s_{i}, {floors[i]}::DOUBLE) * greatest(s_{j}, {floors[j]}::DOUBLE)' + floor(i, j) for i, j in pairs)} FROM summed)",
        f"p0 AS MATERIALIZED (SELECT *, false AS still, {log_det()} FROM (SELECT *, {factor()} FROM start))",
    ]
    entries = [*(f"m_{i}" for i in p), *(f"c_{i}_{j}" for i, j in pairs), *(f"l_{i}_{j}" for j in p for i in p if i >= j), "log_det"]
    for s in range(1, q.STEPS + 1):
        tables += [
            f"d{s} AS (SELECT *, {distance()} FROM points JOIN (SELECT * FROM p{s - 1} WHERE NOT still) USING (gid))",
            f"b{s} AS (SELECT gid, start, bin, count(*) AS n, {', '.join(f'any_value(m_{i}) AS m_{i}' for i in p)}, {', '.join(f'sum({x} - m_{i}) AS s_{i}' for i, x in enumerate(names))}, "
            + ", ".join(f"sum(({names[i]} - m_{i}) * ({names[j]} - m_{j})) AS q_{i}_{j}" for i, j in pairs)
            + f" FROM d{s} GROUP BY gid, start, bin)",
            f"n{s} AS (SELECT *, sum(n) OVER (PARTITION BY gid, start ORDER BY bin) - n AS before, {q.SUPPORT}::DOUBLE * sum(n) OVER (PARTITION BY gid, start) AS most FROM b{s})",
            f"w{s} AS (SELECT *, CASE WHEN before + n < most THEN 1.0::DOUBLE ELSE (most - before) / n END AS w FROM n{s} WHERE before < most)",
            f"t{s} AS (SELECT gid, start, sum(w * n) AS n, {', '.join(f'any_value(m_{i}) AS m_{i}, sum(w * s_{i}) AS s_{i}' for i in p)}, {', '.join(f'sum(w * q_{i}_{j}) AS q_{i}_{j}' for i, j in pairs)} FROM w{s} GROUP BY gid, start)",
            f"e{s} AS (SELECT gid, start, {', '.join(f'm_{i} + s_{i} / n AS m_{i}' for i in p)}, " + ", ".join(f"q_{i}_{j} / n - s_{i} * s_{j} / (n * n){floor(i, j)} AS c_{i}_{j}" for i, j in pairs) + f" FROM t{s})",
            f"f{s} AS (SELECT *, {log_det()} FROM (SELECT *, {factor()} FROM e{s}))",
            f"p{s} AS MATERIALIZED (SELECT f.gid, f.start, {', '.join(f'f.{c}' for c in entries)}, abs(f.log_det - p.log_det) <= {q.TOLERANCE} AS still FROM f{s} f JOIN p{s - 1} p ON f.gid = p.gid AND f.start = p.start"
            f" UNION ALL SELECT gid, start, {', '.join(entries)}, still FROM p{s - 1} WHERE still)",
        ]
    scatter = [f"c_{i}_{j}" for i, j in pairs]
    means = [f"m_{i}" for i in p]
    mean = ", ".join(f"sum(n * {c}) / sum(n) AS {c}" for c in means + scatter)
    share = f"(a.n / (a.n + {float(q.PRIOR)}::DOUBLE))"
    lean = ", ".join(f"{share} * a.{c} + (1 - {share}) * o.{c} AS {c}" for c in means + scatter)
    tables += [
        f"best AS MATERIALIZED (SELECT * FROM p{q.STEPS} QUALIFY row_number() OVER (PARTITION BY gid ORDER BY round(log_det, 9), start) = 1)",
        f"seen AS (SELECT r, gid, {distance()} FROM points JOIN best USING (gid))",
        'c AS (SELECT gid, bin, sum(count(*)) OVER (PARTITION BY gid ORDER BY bin) AS upto, sum(count(*)) OVER (PARTITION BY gid) AS "all" FROM seen GROUP BY gid, bin)',
        f'scale AS (SELECT gid, any_value("all")::DOUBLE AS n, greatest(1.0::DOUBLE, 2.0::DOUBLE ** ((min(bin) + 0.5) / {q.OCTAVE}) / {q.MEDIAN_D2}) AS scale FROM c WHERE 2 * upto >= "all" GROUP BY gid)',
        f"est AS MATERIALIZED (SELECT gid, gid.l AS l, n, {', '.join(means)}, {', '.join(f'{c} * scale AS {c}' for c in scatter)} FROM best JOIN scale USING (gid))",
        f"overall AS MATERIALIZED (SELECT {mean} FROM est)",
        f"spoken AS (SELECT l, sum(n) AS n, {mean} FROM est GROUP BY l)",
        f"language AS MATERIALIZED (SELECT a.l, {lean} FROM spoken a, overall o)",
        f"leant AS (SELECT a.gid, {lean} FROM est a JOIN language o ON a.l IS NOT DISTINCT FROM o.l)",
        f"final AS MATERIALIZED (SELECT *, {factor()} FROM leant)",
        f"judged AS (SELECT r, {distance()} FROM points JOIN final USING (gid))",
    ]
    return (
        "WITH " + ",\n".join(tables) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(d2 <= {q.CUTOFF}, false) AS kept, "
        "n_lines, n_capitals, round(d2, 4) AS d2 FROM stats LEFT JOIN judged USING (r)"
    )


OP4_SQL = op4_sql()
