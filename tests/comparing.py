"""Order-insensitive comparison of two frames."""

import pandas as pd


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)

    def cell(v):
        if v is None or (not isinstance(v, (list, dict, bytes)) and pd.isna(v)):
            return ""
        if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
            return str(v)
        return f"{float(v):.6f}".replace("-0.000000", "0.000000") if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(map(cell, r)) for r in df[cols].astype(object).itertuples(index=False))


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    x, y = canonical(a), canonical(b)
    assert x == y, [(p, q) for p, q in zip(x, y) if p != q][:3]
