"""Array expressions, as SQL text: nested lambdas read better there and parse in one call."""

from __future__ import annotations


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once.

    Inside a lambda Spark re-evaluates an expression wherever it is written; a lambda variable
    holds its value.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _scan(values: str, level: int = 0) -> str:
    """[0, v1, v1+v2, ...]: one element longer than the input.

    Appending to an array copies it, so only every 64th sum is found that way. On two levels the
    sums inside blocks of eight come from three doubling steps, each adding the element 1, 2, 4
    places back; the block totals are scanned one level up.
    """
    if level == 2:
        start = f"transform({values}, x -> CAST(x AS BIGINT))"
        append = "concat(acc, array(element_at(acc, -1) + x))"
        return f"aggregate({start}, array(0L), (acc, x) -> {append})"
    name = f"v{level}_"
    binds = [(f"{name}0", f"transform({values}, x -> CAST(x AS BIGINT))")]
    for step in (1, 2, 4):
        last = binds[-1][0]
        binds.append(
            (
                f"{name}{step}",
                f"transform({last}, (x, i) -> IF(i % 8 >= {step}, x + get({last}, i - {step}), x))",
            )
        )
    last = binds[-1][0]
    totals = f"filter({last}, (x, i) -> i % 8 = 7)"
    binds.append((f"{name}base", _scan(totals, level + 1)))
    body = f"concat(array(0L), transform({last}, (x, i) -> x + get({name}base, int(i / 8))))"
    for bound, value in reversed(binds):
        body = let(bound, value, body)
    return body


def running_totals(values: str) -> str:
    """For every element the sum of the elements before it."""
    return let("sums", _scan(values), "slice(sums, 1, size(sums) - 1)")
