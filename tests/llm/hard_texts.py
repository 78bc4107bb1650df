"""Texts that trick weak hashes."""


def thue_morse(steps, a, b):
    """Two strings that every polynomial hash modulo 2^64 takes for one."""
    x, y = a, b
    for _ in range(steps):
        x, y = x + y, y + x
    return x, y
