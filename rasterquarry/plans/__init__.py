"""Registered queries over the operators, by family."""


def registered() -> tuple[dict, dict]:
    """(queries, SQL) of all families."""
    from . import codec, container, hevc, images, pixels

    queries, sql = {}, {}
    for family in (container, codec, hevc, images, pixels):
        queries |= family.QUERIES
        sql |= family.ORACLES
    return queries, sql
