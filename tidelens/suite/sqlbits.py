"""SQL expressions several oracle texts share."""

from __future__ import annotations

from tidelens import settings as S
from tidelens.functions import geo


def hav(a: str, b: str, c: str, d: str) -> str:
    return (f"(2 * 6371.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) "
            f"* cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))))")


def planar(a: str, b: str, c: str, d: str) -> str:
    return f"sqrt(pow(({b} - {d}) * {geo.KM_X!r}, 2) + pow(({a} - {c}) * {geo.KM_Y!r}, 2))"


def level_int(col: str) -> str:
    return f"(CASE {col} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 0 END)"


def int_level(col: str) -> str:
    return f"(CASE {col} WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' END)"


def zone_level(area: str, eta: str, mn="0.5", low="5.0", med="25.0") -> str:
    return (f"(CASE WHEN {area} < {mn} THEN 'none' WHEN {area} >= {low} AND {eta} <= 24 THEN 'high' "
            f"WHEN {area} >= {med} THEN 'high' WHEN {area} >= {low} THEN 'medium' ELSE 'low' END)")


def region(lat: str, lon: str) -> str:
    return (f"(CASE WHEN {lon} > -69.0 THEN '{S.EAST}' WHEN {lat} > 19.5 THEN '{S.NORTH}' "
            f"WHEN {lon} > -69.5 AND {lon} < -69.0 AND {lat} > 18.9 THEN '{S.SAMANA}' "
            f"WHEN {lon} < -70.5 THEN '{S.SOUTHWEST}' ELSE '{S.SOUTH}' END)")


def season_index(month: str, reg: str) -> str:
    m = " ".join(f"WHEN {k} THEN {v}" for k, v in S.MONTH_INDEX.items())
    r = " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.REGION_EXPOSURE.items())
    return f"((CASE {month} {m} ELSE 0.0 END) * (CASE {reg} {r} ELSE 0.7 END))"


def season_level(month: str, reg: str) -> str:
    i = season_index(month, reg)
    return f"(CASE WHEN {i} < 0.15 THEN 'none' WHEN {i} < 0.35 THEN 'low' WHEN {i} < 0.60 THEN 'medium' ELSE 'high' END)"


def current(lat: str, lon: str, part: str) -> str:
    u = ("-0.22", "-0.18", "-0.12", "-0.08", "-0.13") if part == "u" else ("-0.01", "0.01", "-0.03", "0.01", "0.03")
    return (f"(CASE WHEN {lon} > -69.5 THEN {u[0]} WHEN {lat} BETWEEN 18.9 AND 19.5 AND {lon} BETWEEN -69.7 AND -68.8 THEN {u[1]} "
            f"WHEN {lat} > 19.4 AND {lon} < -70.0 THEN {u[2]} WHEN {lon} < -70.5 AND {lat} < 19.0 THEN {u[3]} ELSE {u[4]} END)")


def unaccent(col: str) -> str:
    return f"strip_accents({col})"


def fold(col: str) -> str:
    return f"trim(regexp_replace(lower({unaccent(col)}), '\\s+', ' ', 'g'))"


def score_cols(prefix: str = "") -> str:
    """Scores of AGG-13 over columns truth and pred."""
    f1 = " + ".join(f"(CASE WHEN count(*) FILTER (truth = {k}) + count(*) FILTER (pred = {k}) > 0 THEN 2.0 * count(*) "
                    f"FILTER (truth = {k} AND pred = {k}) / (count(*) FILTER (truth = {k}) + count(*) FILTER (pred = {k})) ELSE 0.0 END)"
                    for k in range(4))
    seen = " + ".join(f"(CASE WHEN count(*) FILTER (truth = {k} OR pred = {k}) > 0 THEN 1 ELSE 0 END)" for k in range(4))
    return (f"count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 4) AS accuracy, "
            f"round(({f1}) / ({seen}), 4) AS macro_f1, round(avg(abs(truth - pred)), 4) AS mae")


def score_tail() -> str:
    preds = ", ".join(f"count(*) FILTER (pred = {k}) AS pred_{lv}" for k, lv in enumerate(S.LEVELS))
    return ("round(CASE WHEN count(*) FILTER (truth >= 2) > 0 THEN count(*) FILTER (truth >= 2 AND pred >= 2) * 1.0 / "
            "count(*) FILTER (truth >= 2) END, 4) AS pod, round(CASE WHEN count(*) FILTER (pred >= 2) > 0 THEN "
            "count(*) FILTER (truth < 2 AND pred >= 2) * 1.0 / count(*) FILTER (pred >= 2) END, 4) AS far, " + preds)
