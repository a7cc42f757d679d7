"""Compression policy and geometry as SQL expressions that Spark and other SQL engines read alike."""

from __future__ import annotations

KI, MI, GI = 1 << 10, 1 << 20, 1 << 30

# Level by total size (strictly above) and entropy (strictly below; None: any).
LEVEL_BANDS = (
    (2 * GI, ((None, 1),)),
    (GI, ((3.0, 3), (None, 1))),
    (256 * MI, ((3.0, 6), (5.0, 3), (None, 1))),
    (64 * MI, ((3.0, 12), (5.0, 6), (7.0, 3), (None, 1))),
    (16 * MI, ((3.0, 15), (5.0, 9), (7.0, 6), (7.5, 3), (None, 1))),
    (MI, ((3.0, 19), (5.0, 12), (6.5, 6), (7.5, 3), (None, 1))),
    (64 * KI, ((4.0, 9), (6.0, 6), (7.5, 3), (None, 1))),
    (4096, ((5.0, 6), (7.0, 3), (None, 1))),
    (-1, ((6.0, 3), (None, 1))),
)
# Fixed values: (total size strictly above, value).
DIR_CAPS = ((GI, 1), (512 * MI, 3), (128 * MI, 6), (-1, 22))
WINDOW_LOGS = ((GI, 30), (512 * MI, 27), (128 * MI, 26), (32 * MI, 24), (-1, 22))
MEMORY_WINDOW_LOGS = ((GI, 30), (512 * MI, 27), (128 * MI, 26), (32 * MI, 24), (4 * MI, 22), (-1, 21))
DECODE_WINDOW_LOGS = ((2 * GI, 30), (512 * MI, 29), (128 * MI, 27), (-1, 24))
STORE_AT, FAST_AT = 7.95, 7.5
STREAM_FROM = 64 * MI


def ladder(x: str, steps) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {at} THEN {v}" for at, v in steps) + " END"


def adaptive_level(total: str, entropy: str, requested: int) -> str:
    rows = []
    for at, steps in LEVEL_BANDS:
        inner = " ".join(f"WHEN {entropy} < {e} THEN {v}" for e, v in steps if e is not None)
        last = steps[-1][1]
        rows.append(f"WHEN {total} > {at} THEN " + (f"CASE {inner} ELSE {last} END" if inner else str(last)))
    return f"least({min(max(requested, 1), 22)}, CASE {' '.join(rows)} END)"


def codec_route(size: str, entropy: str) -> str:
    """store, fast (one quick attempt) or best (the smallest of several)."""
    return f"CASE WHEN {size} = 0 OR {entropy} >= {STORE_AT} THEN 'store' WHEN {entropy} >= {FAST_AT} THEN 'fast' ELSE 'best' END"


def stream_predicate(size: str, named: str, budget_mb: str) -> str:
    return f"({named} OR {size} >= {STREAM_FROM} OR {size} >= greatest(floor({budget_mb} * {MI} * 60 / 100), {STREAM_FROM}))"


def png_side(payload: str, name_length: str, list_length: str = "0") -> str:
    """Side of the square image: payload header, list, padding to whole pixels, markers."""
    meta = f"(10 + {name_length} + {payload} + CASE WHEN {list_length} > 0 THEN 8 + {list_length} ELSE 0 END)"
    padded = f"(ceil((4 + {meta}) / 3.0) * 3)"
    pixels = f"(ceil((12 + {padded}) / 3.0) + 3)"
    return f"CAST(greatest(ceil(sqrt({pixels})), 3) AS BIGINT)"


def png_file_size(side: str, list_length: str = "0") -> str:
    """Signature, header, image data as stored blocks in chunks of 64 MiB, list chunk, end."""
    scan = f"({side} * (3 * {side} + 1))"
    idat = f"(6 + 5 * ceil({scan} / 65535.0) + {scan})"
    return f"CAST(8 + 25 + {idat} + 12 * ceil({idat} / {64.0 * MI}) + CASE WHEN {list_length} > 0 THEN 12 + {list_length} ELSE 0 END + 12 AS BIGINT)"


def ecc_blocks(size: str, nsym: int) -> str:
    return f"CAST(ceil({size} / {255.0 - nsym}) AS BIGINT)"


def image_side(bits: str) -> str:
    return f"CAST(greatest(ceil(sqrt({bits} + 256)), 20) AS BIGINT)"


def ext_of(path: str, dialect: str) -> str:
    """What follows the last dot of the whole path; empty without a dot."""
    if dialect == "spark":
        return f"CASE WHEN instr({path}, '.') = 0 THEN '' ELSE substring_index({path}, '.', -1) END"
    return f"CASE WHEN instr({path}, '.') = 0 THEN '' ELSE regexp_extract({path}, '([^.]*)$', 1) END"
