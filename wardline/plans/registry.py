"""How a module of queries collects its functions and their SQL."""


def counted(sql: str) -> str:
    """count_if(x) as count(case when x then 1 end), which DuckDB gives as a bigint."""
    mark = "count_if("
    while mark in sql:
        at = sql.index(mark)
        depth, end = 1, at + len(mark)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(case when {sql[at + len(mark) : end - 1]} then 1 end){sql[end:]}"
    return sql


def registry() -> tuple[dict, dict, object]:
    queries, sql = {}, {}

    def query(text: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = counted(text)
            return f
        return keep

    return queries, sql, query
