"""DuckDB SQL for those operators that SQL can express."""

from __future__ import annotations

import math

from marlstone.llm import quality_rules as Q

_SPACE = r"\x20\x09-\x0D"


def quality_rules_sql() -> str:
    """Counts by lists and windows, sketches by bucket counts, fences by cumulative counts."""
    gamma = (1 + Q.ACCURACY) / (1 - Q.ACCURACY)
    ratio = {k: f"{a} / nullif({b}, 0)" for k, (a, b, _, _) in Q.RATIOS.items()}
    each = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, CASE WHEN {x} > 1e-6 THEN CAST(ceil(ln({x}) / {math.log(gamma)!r}) AS INTEGER) ELSE -1000000 END AS bucket FROM counts WHERE NOT base_failed" for k, x in ratio.items())

    def fences(name: str, keys: list[str]) -> str:
        k = ", ".join([*keys, "ratio"])
        cols = []
        for r, (_, _, _, below) in Q.RATIOS.items():
            spread = f"{Q.SPREADS} * (q1 - q0)"
            cols.append(f"max(CASE WHEN ratio = '{r}' THEN q1 + {spread} END) AS {r}_hi")
            if below:
                cols.append(f"max(CASE WHEN ratio = '{r}' THEN q1 - {spread} END) AS {r}_lo")
        group = f"GROUP BY {', '.join(keys)}" if keys else ""
        lead = "".join(f"{x}, " for x in keys)
        return (
            f"{name}_h AS (SELECT {k}, bucket, count(*) AS n FROM each GROUP BY {k}, bucket), "
            f"{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {k}) AS docs, CASE WHEN bucket > -1000000 THEN 2 * pow({gamma!r}, bucket) / {gamma + 1!r} ELSE 0 END AS value FROM {name}_h), "
            f"{name}_q AS (SELECT {k}, max(docs) AS docs, min(value) FILTER (WHERE below >= 0.1 * docs) AS q0, min(value) FILTER (WHERE below >= 0.5 * docs) AS q1 FROM {name}_c GROUP BY {k}), "
            f"{name} AS (SELECT {lead}max(docs) AS docs, {', '.join(cols)} FROM {name}_q {group})"
        )

    limit = lambda c: f"CASE WHEN own.docs >= {Q.MIN_GROUP} THEN own.{c} WHEN by_lang.docs >= {Q.MIN_GROUP} THEN by_lang.{c} ELSE by_all.{c} END"
    failed = []
    for r, (a, b, unit, below) in Q.RATIOS.items():
        error = f"{Q.ERRORS} * sqrt({a} * {unit})"
        bad = f"({a} - {error}) / nullif({b}, 0) > {limit(f'{r}_hi')}"
        if below:
            bad = f"({bad} OR ({a} + {error}) / nullif({b}, 0) < {limit(f'{r}_lo')})"
        failed.append(f"CASE WHEN {bad} THEN '{r}' END")
    base = ", ".join(["doc_id", *Q.COUNTS, "base_failed"])
    return f"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS ws FROM documents),
runs AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM texts WHERE len(ws) > 2),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS n FROM runs) WHERE n > 1),
marked AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS ls FROM texts),
raw AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[{_SPACE}]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(marked.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper,
  CAST(length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS BIGINT) AS n_marks
  FROM texts JOIN lines USING (doc_id) LEFT JOIN marked USING (doc_id)),
counts AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM raw),
each AS ({each}),
{fences('own', ['lang', 'source'])},
{fences('by_lang', ['lang'])},
{fences('by_all', [])},
judged AS (SELECT {', '.join('counts.' + c for c in base.split(', '))}, concat_ws(',', {', '.join(failed)}) AS failed_rules FROM counts
  LEFT JOIN own ON counts.lang IS NOT DISTINCT FROM own.lang AND counts.source IS NOT DISTINCT FROM own.source LEFT JOIN by_lang ON counts.lang IS NOT DISTINCT FROM by_lang.lang CROSS JOIN by_all)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM judged
"""
