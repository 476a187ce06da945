"""Text in, answer out: parse, validate, resolve, compile, and tell."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tallyloom.model import Query, from_json
from tallyloom.operators import retrieval
from tallyloom.plans.compiler import Compiled, compile
from tallyloom.plans.questions import parse
from tallyloom.plans.render import summary


@dataclass(frozen=True)
class Profile:
    """Who asks; what has an owner is theirs alone."""

    worker_id: str = ""
    org_id: str = ""
    name: str = ""
    center: str = ""
    route: str = ""
    permissions: tuple[str, ...] = field(default=())

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.worker_id, self.org_id, self.name, self.center, self.route, list(self.permissions))], "worker_id string, org_id string, name string, center string, route string, permissions array<string>")


@dataclass(frozen=True)
class Answer:
    query: Query
    made: Compiled
    text: str
    rows: DataFrame | None = None


@dataclass
class Engine:
    relation: DataFrame
    registry: DataFrame
    profile: Profile
    as_of: datetime
    knowledge: DataFrame | None = None
    organization: str = ""
    #: Names looked for in questions; the registry itself is only ever asked about one mention.
    names: tuple[str, ...] = ()

    def run(self, q: Query) -> Answer:
        made = compile(q, self.relation, self.as_of, self.registry, self.profile.org_id or None, self.profile.worker_id or None)
        if made.status == "CONFIG":
            text = f"{self.profile.name} ({self.profile.worker_id}), {self.profile.center}, {self.profile.route}" if q.target == "WORKER_PROFILE" else self.organization
            return Answer(q, made, text)
        if made.status == "KNOWLEDGE":
            found = retrieval.search(self.knowledge, q.knowledge or "", 1) if self.knowledge is not None else None
            best = found.first() if found is not None else None
            return Answer(q, made, best["content"] if best else "No document answers this.", found)
        return Answer(q, made, summary(q, made), made.df)

    def ask(self, text: str) -> Answer:
        """A JSON object or a question in words."""
        q = from_json(text) if text.lstrip().startswith("{") else None
        return self.run(q or parse(text, list(self.names)))
