"""The engine: SQL text of the dialect over registered tables, with native DataFrames underneath."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemill import security
from lakemill.catalog import Catalog, Router, Table
from lakemill.operators.relational import DEFAULT_LEAST_GROUP
from lakemill.sources import readers, sinks
from lakemill.sql.tokens import SqlError, Token, closing, scan, text, top_level
from lakemill.sql.translate import translate
from lakemill.types import published

_FUNCTIONS = [
    """CREATE OR REPLACE TEMPORARY FUNCTION timediff_text(a TIMESTAMP_NTZ, b TIMESTAMP_NTZ) RETURNS STRING RETURN
       concat(CASE WHEN a < b THEN '-' ELSE '' END, format_string('%02d:%02d:%02d',
       abs(timestampdiff(SECOND, b, a)) div 3600, abs(timestampdiff(SECOND, b, a)) % 3600 div 60, abs(timestampdiff(SECOND, b, a)) % 60))""",
]

_AFTER_TABLE = {"WHERE", "GROUP", "ORDER", "LIMIT", "HAVING", "WINDOW", "JOIN", "LEFT", "RIGHT", "INNER", "CROSS", "ON", "UNION", "INTO", "NATURAL"}


class Engine:
    """``router`` and ``sources`` (an id to kind and settings of ``sources.readers``) serve tables that are not registered:
    a query's ``db.table`` is read from the source that the router names, with ``table`` added to its settings."""

    def __init__(
        self,
        spark: SparkSession,
        least_group: int | None = None,
        config: security.SecurityConfig | None = None,
        router: Router | None = None,
        sources: dict[str, dict] | None = None,
    ):
        given = config.least_group if config else DEFAULT_LEAST_GROUP
        self.spark, self.least_group, self.config = spark, given if least_group is None else least_group, config
        self.router, self.sources = router, sources or {}
        self.catalog = Catalog(spark)
        self.views: dict[str, tuple[str, list[str], dict | None]] = {}
        for f in _FUNCTIONS:
            spark.sql(f)

    def register(self, name: str, kind: str, owner: str = "", sink=None, **how) -> DataFrame:
        """Registers a table of some source kind (see ``sources.readers``)."""
        return self.catalog.add(Table(name, lambda s: readers.read(s, kind, **how), owner, sink=sink))

    def register_folder(self, folder: str, names: list[str]) -> None:
        for n in names:
            self.register(n, "parquet", path=f"{folder}/{n}.parquet")

    def sql(self, query: str, params: dict | None = None, least_group: int | None = None, party: str | None = None) -> DataFrame:
        """One statement: SELECT, UNION, INSERT ... SELECT, CREATE/DROP VIEW, SHOW, DESCRIBE, EXPLAIN of those."""
        tokens = scan(query)
        if not tokens:
            raise SqlError("no statement")
        first = tokens[0].word
        if first in ("SELECT", "(") or tokens[0].text == "(":
            return self._select(query, params, least_group, party)
        if first == "INSERT":
            return self._insert(tokens, params, least_group, party)
        if first == "CREATE" and any(t.word == "VIEW" for t in tokens[:4]):
            return self._create_view(tokens, params)
        if first == "DROP" and tokens[1].word == "VIEW":
            name = tokens[-1].text.strip("`")
            self.views.pop(name.lower(), None)
            self.catalog.drop(name)
            return self.spark.createDataFrame([], "ok boolean")
        if first in ("SHOW", "DESCRIBE", "DESC", "EXPLAIN"):
            body = tokens[1:] if first == "EXPLAIN" else tokens
            if first == "EXPLAIN" and body and body[0].word not in ("SHOW", "DESCRIBE", "DESC"):
                body = [scan("DESCRIBE")[0], *body] if body[0].word != "SELECT" else body
                if body[0].word == "SELECT":
                    raise SqlError("EXPLAIN takes a table, not a query")
            return self.spark.sql(text(body))
        raise SqlError(f"{first or tokens[0].text} statements are not supported")

    def _create_view(self, tokens, params) -> DataFrame:
        """CREATE [OR REPLACE] VIEW name [(columns)] AS SELECT ...; kept as text, as each use has its own least group."""
        at = next(i for i, t in enumerate(tokens) if t.word == "AS")
        name_at = next(i for i, t in enumerate(tokens) if t.word == "VIEW") + 1
        name = tokens[name_at].text.strip("`")
        columns = [t.text.strip("`") for t in tokens[name_at + 1 : at] if t.kind == "name"]
        self.views[name.lower()] = (text(tokens[at + 1 :]), columns, params)
        try:
            self._define(name.lower(), self.least_group)
        except Exception:
            del self.views[name.lower()]
            raise
        return self.spark.createDataFrame([], "ok boolean")

    def _define(self, name: str, least_group: int) -> None:
        body, columns, params = self.views[name]
        df = self._select(body, params, least_group, None, inside=name)
        if columns and len(columns) != len(df.columns):
            raise SqlError(f"view {name} names {len(columns)} columns, its query has {len(df.columns)}")
        (df.toDF(*columns) if columns else df).createOrReplaceTempView(name)

    def _sources_of(self, tokens):
        """The tokens with ``db.table`` replaced by its view; tables that only the router knows are registered."""
        out, i = [], 0
        while i < len(tokens):
            t = tokens[i]
            if t.kind == "name" and i + 2 < len(tokens) and tokens[i + 1].text == "." and tokens[i + 2].kind == "name" and (not out or out[-1].text != "."):
                name = f"{t.text}.{tokens[i + 2].text}".replace("`", "")
                opens = bool(out) and (out[-1].word in ("FROM", "JOIN", "INTO", "TABLE") or out[-1].text == ",")
                if name.lower() not in self.catalog.tables and opens and self.router and out[-1].text != ",":
                    how = dict(self.sources[self.router.route(name)])
                    self.register(name, how.pop("kind"), owner=t.text, **{"table": name.split(".")[1], **how})
                if name.lower() in self.catalog.tables:
                    view = Token("name", self.catalog.view_of(name))
                    following = tokens[i + 3] if i + 3 < len(tokens) else None
                    out.append(view if opens else tokens[i + 2])
                    aliased = following is not None and (following.word == "AS" or following.kind == "name" and following.word not in _AFTER_TABLE)
                    if opens and not aliased:
                        out += [Token("name", "AS"), tokens[i + 2]]
                    i += 3
                    continue
            out.append(t)
            i += 1
        return out

    def _kinds(self, tokens) -> dict[str, str]:
        """Kinds of the columns of the tables that a query names; of two kinds by one name, none."""
        words = {t.text.strip("`").lower() for t in tokens if t.kind == "name"}
        out: dict[str, str] = {}
        for name, table in self.catalog.tables.items():
            if self.catalog.view_of(name).lower() in words:
                for column, kind in table.kinds.items():
                    out[column] = kind if out.get(column, kind) == kind else ""
        return out

    def _select(self, query: str, params, least_group, party, inside: str = "") -> DataFrame:
        tokens = self._sources_of(scan(query))
        at = top_level(tokens, {"INTO"})
        if at >= 0:
            return self._outfile(tokens, at, params, least_group, party)
        if top_level(tokens, {"FROM"}) < 0 and tokens[0].word == "SELECT":
            raise SqlError("FROM is mandatory")
        k = self.least_group if least_group is None else least_group
        for name in {t.text.strip("`").lower() for t in tokens if t.kind == "name"} & set(self.views) - {inside}:
            self._define(name, k)
        df = self.spark.sql(translate(text(tokens), k, self._kinds(tokens)), args=params or None)
        if party and self.config:
            security.check(df, party, self.config, {n: t.columns for n, t in self.catalog.tables.items()})
        return df

    def _insert(self, tokens, params, least_group, party) -> DataFrame:
        if len(tokens) < 4 or tokens[1].word != "INTO":
            raise SqlError("INSERT INTO table (columns) SELECT ... is the only form")
        at = top_level(tokens, {"SELECT"})
        columns = re.match(r".*?\(([^()]*)\)\s*$", text(tokens[:at]), re.S)
        if at < 0 or not columns:
            raise SqlError("INSERT needs a list of columns and a SELECT")
        name = text(tokens[2 : next(i for i, t in enumerate(tokens) if t.text == "(")])
        table = self.catalog.get(name)
        if table.sink is None:
            raise SqlError(f"{name} cannot be written")
        names = [c.strip().strip("`") for c in columns[1].split(",")]
        # the table's owner gets the rows
        df = self._select(text(tokens[at:]), params, least_group, table.owner or party)
        if len(names) != len(df.columns):
            raise SqlError("the numbers of columns differ")
        df = df.toDF(*names)
        table.sink(df)
        return df

    def _outfile(self, tokens, at, params, least_group, party) -> DataFrame:
        """SELECT ... INTO OUTFILE [PARTY_CODE 'p'] 'path' [(columns)] [, PARTY_CODE ...] [FIELDS TERMINATED BY ..]
        [OPTIONALLY] ENCLOSED BY .. LINES TERMINATED BY ..; each party's columns are checked for that party.

        A path that ends with / is a folder of part files, written by all tasks; another is one file, written by one.
        """
        end = top_level(tokens, {"FROM"}, at)
        clause = tokens[at : end if end >= 0 else len(tokens)]
        rest = tokens[end:] if end >= 0 else []
        df = self._select(text([*tokens[:at], *rest]), params, least_group, None)
        words = [t.word for t in clause]
        files: list[tuple[str, str, list[str]]] = []
        who = party or ""
        for i, t in enumerate(clause):
            if t.kind != "string" or clause[i - 1].word == "BY":
                continue
            if clause[i - 1].word == "PARTY_CODE":
                who = t.text[1:-1]
                continue
            some = []
            if i + 1 < len(clause) and clause[i + 1].text == "(":
                some = [x.text.strip("`") for x in clause[i + 2 : closing(clause, i + 1)] if x.kind == "name"]
            files.append((who, t.text[1:-1], some))
            who = party or ""
        if not files:
            raise SqlError("OUTFILE needs a path")
        if self.config:
            tables = {n: t.columns for n, t in self.catalog.tables.items()}
            for who, _, some in files:
                if not who:
                    raise SqlError("OUTFILE needs a PARTY_CODE where columns are controlled")
                security.check(df, who, self.config, tables, some or None)
        by = {clause[i - 1].word + ("L" if i > 1 and clause[i - 2].word == "LINES" else ""): clause[i + 1].text[1:-1] for i, t in enumerate(clause) if t.word == "BY"}
        unescape = lambda s: s.replace("\\n", "\n").replace("\\t", "\t").replace("\\r", "\r")
        quoting = sinks.QUOTE_NONE if "ENCLOSED" not in by else sinks.QUOTE_STRINGS if "OPTIONALLY" in words else sinks.QUOTE_ALL
        for _, p, some in files:
            unknown = {c.lower() for c in some} - {c.lower() for c in df.columns}
            if unknown:
                raise SqlError(f"no such columns: {sorted(unknown)}")
            own = df.select(*[F.col(f"`{c}`") for c in some]) if some else df
            sinks.dump_file(own, p, unescape(by.get("TERMINATED", ",")), quoting, unescape(by.get("TERMINATEDL", "\\n")), single=not p.endswith("/"))
        return df

    def publish(self, df: DataFrame, most_rows: int = 1_000_000) -> list:
        """The rows of a result on the driver, in the form that callers see; more than ``most_rows`` raise an error."""
        rows = published(df).limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"the result has more than {most_rows} rows; write it to a file")
        return rows
