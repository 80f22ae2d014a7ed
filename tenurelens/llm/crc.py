"""CRC-32 as an SQL expression, for engines without such a function."""

from __future__ import annotations

ONES = 0xFFFFFFFF
#: The reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _entry(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (POLYNOMIAL if byte & 1 else 0)
    return byte


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, as bigint; NULL for NULL."""
    table = ", ".join(str(_entry(b)) for b in range(256))
    digits = f"hex(encode({text}))"
    values = f"list_transform(range(1, length({digits}), 2), lambda i: ('0x' || substr({digits}, i, 2))::bigint)"
    step = f"lambda c, b: xor(c >> 8, list_extract([{table}]::bigint[], (xor(c, b) & 255) + 1))"
    return f"xor(list_reduce(list_prepend({ONES}::bigint, {values}), {step}), {ONES}::bigint)"
