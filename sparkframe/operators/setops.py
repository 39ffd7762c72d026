"""Concatenation of frames with equal schemas."""

from __future__ import annotations

import functools


def concat(frames):
    """All rows of all frames, duplicates kept. Names, their order and types must be equal."""
    from sparkframe.operators.frame import DataFrame

    if frames is None:
        return None
    frames = list(frames)
    if not frames:
        raise ValueError("concat needs a frame")
    first = [(f.name, f.dataType) for f in frames[0].sdf.schema]
    for x in frames[1:]:
        if [(f.name, f.dataType) for f in x.sdf.schema] != first:
            raise ValueError("concat needs frames with the same columns, in order, of the same types")
    return DataFrame(functools.reduce(lambda a, b: a.union(b), [x.sdf for x in frames]))
