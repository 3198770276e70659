"""SQL of logistic fits by Newton's method, for the twins of fitted models."""

from __future__ import annotations


def _solved(source: str, keys: list[str], size: int) -> str:
    """Solve ``a`` x = ``g`` for each row by elimination, as nested selects."""
    kept = [*keys, *[f"b{i}" for i in range(size)]]
    for k in range(size):
        cells = [f"a{i}{j}" for i in range(k + 1) for j in range(i, size)]
        cells += [f"g{i}" for i in range(k + 1)]
        for i in range(k + 1, size):
            cells += [
                f"a{i}{j} - a{k}{i} / a{k}{k} * a{k}{j} AS a{i}{j}" for j in range(i, size)
            ]
            cells.append(f"g{i} - a{k}{i} / a{k}{k} * g{k} AS g{i}")
        source = f"(SELECT {', '.join([*kept, *cells])} FROM {source})"
    for k in range(size - 1, -1, -1):
        known = "".join(f" - a{k}{j} * x{j}" for j in range(k + 1, size))
        source = f"(SELECT *, (g{k}{known}) / a{k}{k} AS x{k} FROM {source})"
    moved = ", ".join(f"b{i} + x{i} AS b{i}" for i in range(size))
    return f"SELECT {', '.join(keys)}, {moved} FROM {source}"


def newton_ctes(
    rows: str,
    models: str,
    keys: list[str],
    size: int,
    *,
    match: str,
    steps: int,
    weight: str = "1",
    ridge: str = "0",
    penalty: str = "0",
) -> str:
    """CTEs ``w0`` to ``w{steps}`` of the coefficients ``b0``, ``b1``, ... per model.

    ``rows`` has y and z1, z2, ...; ``models`` has the keys and m1, m2, ..., 0 for
    an input that a model lacks. ``match`` joins a row r to a model m. ``ridge``
    damps the Hessian only, ``penalty`` belongs to the objective.
    """
    n = range(size)
    z = ["1", *[f"m{i} * z{i}" for i in range(1, size)]]
    margin = " + ".join([f"b{i} * {z[i]}" for i in n])
    key = ", ".join(keys)
    ctes = [f"w0 AS (SELECT {key}, {', '.join(f'0::DOUBLE AS b{i}' for i in n)} FROM {models})"]
    for t in range(steps):
        cells = []
        for i in n:
            for j in range(i, size):
                extra = f" + {ridge} + {penalty} + 1 - any_value(m{i})" if i == j and i else ""
                cells.append(f"sum(v * ({z[i]}) * ({z[j]})){extra} AS a{i}{j}")
            shrink = f" - {penalty} * any_value(b{i})" if i else ""
            cells.append(f"sum(u * (y - p) * ({z[i]})){shrink} AS g{i}")
        scored = (
            f"SELECT *, u * greatest(p * (1 - p), 1e-6) AS v FROM (SELECT r.*, m.*, w.* EXCLUDE "
            f"({key}), {weight} AS u, 1 / (1 + exp(-({margin}))) AS p "
            f"FROM {models} m JOIN w{t} w USING ({key}) JOIN {rows} r ON {match})"
        )
        sums = (
            f"(SELECT {key}, {', '.join(f'any_value(b{i}) AS b{i}' for i in n)}, "
            f"{', '.join(cells)} FROM ({scored}) GROUP BY {key})"
        )
        ctes.append(f"w{t + 1} AS MATERIALIZED ({_solved(sums, keys, size)})")
    return ",\n".join(ctes)
