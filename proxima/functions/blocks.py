"""Per-code feature blocks, computed once per schema on the driver.

A *coded* feature (one-hot, strict one-hot, ordinal, bin, bin-ordinal, hierarchy) maps a
value to an integer code; its vector block is row ``code`` of a small matrix ``B``
whose size is fixed by the declared values, never by the data.  Distances between
codes only need the Gram matrix ``G = B Bᵀ``, which is what the kNN join uses.

Code 0 is always the "unknown" code (bin codes have no unknown: 0 is the first bin).
"""

from __future__ import annotations

import numpy as np

from ..schema import EncoderSpec


# ------------------------------------------------------------------ hierarchy
def tree_leaves(tree) -> list:
    """Leaves of a nested dict / list / str tree, in declaration order."""
    if isinstance(tree, str):
        return [tree]
    if isinstance(tree, (list, tuple)):
        out = []
        for x in tree:
            out.extend(tree_leaves(x))
        return out
    if isinstance(tree, dict):
        out = []
        for v in tree.values():
            out.extend(tree_leaves(v))
        return out
    raise TypeError(f"Unsupported type {type(tree)}")


def _leaf_paths(tree, prefix=()) -> dict:
    """leaf -> (path of dict keys from the root, id of the containing list or None)."""
    out = {}
    if isinstance(tree, str):
        out[tree] = (prefix, None)
    elif isinstance(tree, (list, tuple)):
        for x in tree:
            if isinstance(x, str):
                out[x] = (prefix, prefix)
            else:
                out.update(_leaf_paths(x, prefix))
    elif isinstance(tree, dict):
        for k, v in tree.items():
            out.update(_leaf_paths(v, prefix + (k,)))
    else:
        raise TypeError(f"Unsupported type {type(tree)}")
    return out


def _depth_below(path: tuple, in_list: bool, lca_len: int) -> int:
    # one level per dict key below the common ancestor, plus one for a list
    return (len(path) - lca_len) + (1 if in_list else 0)


def tree_distance(tree, a, b) -> int:
    """0 for the same leaf, 1 for siblings (same list), otherwise the depth of a plus the
    depth of b below their lowest common ancestor."""
    return _path_distance(a, b, _leaf_paths(tree))


def _path_distance(a, b, paths) -> int:
    if a == b:
        return 0
    pa, la = paths[a]
    pb, lb = paths[b]
    if la is not None and la == lb:
        return 1
    n = 0
    while n < min(len(pa), len(pb)) and pa[n] == pb[n]:
        n += 1
    return _depth_below(pa, la is not None, n) + _depth_below(pb, lb is not None, n)


# ------------------------------------------------------------------ sizes
def encoder_length(e: EncoderSpec) -> int:
    t = e.type
    if t == "numeric":
        return 1
    if t in ("onehot", "ordinal", "bin", "bin_ordinal"):
        return len(e.values) + 1
    if t == "strict_onehot":
        return len(e.values)
    if t == "hierarchy":
        return len(tree_leaves(e.values)) + 1
    return int(e.length)


def nonzero_elements(e: EncoderSpec) -> float:
    if e.type in ("ordinal", "bin_ordinal"):
        return float(len(e.window))
    if e.type == "hierarchy":
        return len(tree_leaves(e.values)) / len(e.values)
    return 1.0


def code_values(e: EncoderSpec) -> list:
    """Declared values in code order (code = position + 1; code 0 = unknown)."""
    if e.type == "hierarchy":
        return tree_leaves(e.values)
    return list(e.values)


def n_codes(e: EncoderSpec) -> int:
    return len(code_values(e)) + 1


# ------------------------------------------------------------------ blocks
# Row ``code`` of a feature's block matrix is kept sparse ({slot: value}): one entry for
# one-hot features, the window for ordinal ones, the similar leaves for trees.  Nothing
# here is quadratic in the number of declared values.

def _window_row(n_slots: int, centre: int, window, lo: int) -> dict[int, float]:
    """Window centred at ``centre``, clipped to slots lo..n_slots-1."""
    half = len(window) // 2
    return {centre + off: float(window[half + off]) for off in range(-half, half + 1)
            if lo <= centre + off < n_slots and window[half + off]}


def _tree_rows(e: EncoderSpec) -> list[dict[int, float]]:
    leaves, sims = tree_leaves(e.values), list(e.similarity_by_depth)
    paths = _leaf_paths(e.values)
    rows = []
    for a in leaves:
        row = {}
        for j, b in enumerate(leaves):
            d = _path_distance(a, b, paths)
            if d < len(sims) and sims[d]:
                row[1 + j] = float(sims[d])
        rows.append(row)
    return rows


def identity(e: EncoderSpec) -> bool:
    """One-hot features, whose Gram matrix is the identity (strict one-hot: but for the
    unknown code, whose block is zero): they need no table at all."""
    return e.type in ("onehot", "bin", "strict_onehot")


def block_rows(e: EncoderSpec) -> list[dict[int, float]]:
    """Unweighted block of every code as {slot: value}."""
    t, n = e.type, len(code_values(e))
    if t in ("onehot", "bin"):
        return [{c: 1.0} for c in range(n + 1)]
    if t == "strict_onehot":
        return [{}] + [{c: 1.0} for c in range(n)]
    if t == "ordinal":
        return [{0: 1.0}] + [_window_row(n + 1, c, e.window, 1) for c in range(1, n + 1)]
    if t == "bin_ordinal":
        return [_window_row(n + 1, c, e.window, 0) for c in range(n + 1)]
    if t == "hierarchy":
        return [{0: 1.0}] + _tree_rows(e)
    raise TypeError(f"{t} is not a coded encoder")


def block_matrix(e: EncoderSpec) -> np.ndarray:
    """The blocks as a dense matrix (n_codes, length); for small features and tests."""
    out = np.zeros((n_codes(e), encoder_length(e)))
    for i, row in enumerate(block_rows(e)):
        for j, v in row.items():
            out[i, j] = v
    return out


def cross_products(left: list[dict[int, float]], right: list[dict[int, float]]) -> list[dict[int, float]]:
    """Non-zero dot products of every left row with the right rows ({right code: value})."""
    by_slot: dict[int, list[tuple[int, float]]] = {}
    for b, row in enumerate(right):
        for slot, v in row.items():
            by_slot.setdefault(slot, []).append((b, v))
    out = []
    for row in left:
        acc: dict[int, float] = {}
        for slot, v in row.items():
            for b, w in by_slot.get(slot, ()):
                acc[b] = acc.get(b, 0.0) + v * w
        out.append(dict(sorted(acc.items())))
    return out


def gram_rows(e: EncoderSpec) -> list[dict[int, float]]:
    """Non-zero entries of the Gram matrix, row by row."""
    rows = block_rows(e)
    return cross_products(rows, rows)


def gram_diagonal(e: EncoderSpec) -> list[float]:
    return [sum(v * v for v in row.values()) for row in block_rows(e)]


def gram(e: EncoderSpec) -> np.ndarray:
    b = block_matrix(e)
    return b @ b.T


def separation(e: EncoderSpec) -> float:
    """Smallest squared distance between two different codes' blocks (0 with one code)."""
    n = n_codes(e)
    if n < 2:
        return 0.0
    if identity(e):
        return 1.0 if e.type == "strict_onehot" else 2.0
    rows, diag = gram_rows(e), gram_diagonal(e)
    best, order = float("inf"), sorted(diag)
    for a, row in enumerate(rows):
        for b, g in row.items():
            if b != a:
                best = min(best, diag[a] - 2 * g + diag[b])
    # pairs without common slots: at least the two smallest norms
    return max(0.0, min(best, order[0] + order[1]))


def cross_rows(user: EncoderSpec, item: EncoderSpec) -> list[dict[int, float]]:
    """Dot products of user-side blocks with item-side blocks."""
    if encoder_length(user) != encoder_length(item):
        raise ValueError(f"user encoder of {item.field} must have the item encoder's length")
    return cross_products(block_rows(user), block_rows(item))


def numeric_values(e: EncoderSpec) -> bool:
    """True when the declared values are numbers, so lookups compare numerically."""
    vals = code_values(e)
    return bool(vals) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in vals)
