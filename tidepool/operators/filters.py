"""Table filters that are applied below a search's aggregate."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many ids are a literal list, which is pushed into the scan.
LITERAL_IDS = 1000


@dataclass(frozen=True)
class IdFilter:
    """``allow`` None lets all tables pass, an empty one none."""

    allow: frozenset[int] | None = None
    deny: frozenset[int] = frozenset()

    @classmethod
    def of(cls, allow: Iterable[int] | None = None, deny: Iterable[int] = ()) -> IdFilter:
        return cls(None if allow is None else frozenset(allow), frozenset(deny))

    def also(self, allow: Iterable[int] | None = None, deny: Iterable[int] = ()) -> IdFilter:
        """Both filters: allowed ids must be in each list, denied ones are in either."""
        both = self.allow if allow is None else frozenset(allow) if self.allow is None else self.allow & frozenset(allow)
        return IdFilter(both, self.deny | frozenset(deny))

    @property
    def empty(self) -> bool:
        return self.allow is not None and not (self.allow - self.deny)

    def passing(self, n: int) -> list[int] | None:
        """Of the tables 0 to ``n`` - 1 those that pass; None if all do."""
        return None if self.allow is None and not self.deny else [i for i in range(n) if (self.allow is None or i in self.allow) and i not in self.deny]

    def on(self, df: DataFrame, column: str = "table_id") -> DataFrame:
        if self.empty:
            return df.where(F.lit(False))
        spark = df.sparkSession
        for ids, how, keep in ((self.allow, "left_semi", True), (self.deny or None, "left_anti", False)):
            if ids is None:
                continue
            if len(ids) <= LITERAL_IDS:
                test = F.col(column).isin(sorted(ids))
                df = df.where(test if keep else ~test)
            else:
                df = df.join(spark.createDataFrame([(i,) for i in sorted(ids)], f"{column} int"), column, how)
        return df
