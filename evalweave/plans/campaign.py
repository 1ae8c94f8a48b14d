"""Running a campaign: phases and datasets of a model in turn, each resumed where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, replace
from itertools import product, starmap

from pyspark.sql import DataFrame

from ..operators.sampling import unfinished

#: Attempts, the code that allows another one, and the order of phases and datasets.
ATTEMPTS, AGAIN = 3, 42
PHASES, DATASETS = ("pilot", "dev20"), ("avspeaker", "joint")


@dataclass(frozen=True)
class Step:
    """One phase of one dataset: waiting, running, complete, or in need of diagnosis, which ends the lane."""

    phase: str
    dataset: str
    attempt: int = 0
    status: str = "waiting"

    def begun(self) -> Step:
        return replace(self, attempt=self.attempt + 1, status="running")

    def after(self, code: int) -> Step:
        """What an exit code makes of a running step: only lacking memory is tried again, as long as attempts are left."""
        if code == AGAIN and self.attempt < ATTEMPTS:
            return self.begun()
        return replace(self, status="needs_diagnosis" if code else "complete")


def carried_out(step: Step, work: Callable[[str, str], int], report: Callable[[dict], None]) -> Step:
    """A step from its first attempt to its end; every state on the way is reported, but for completion."""
    step = step.begun()
    while step.status == "running":
        report(asdict(step))
        code = work(step.phase, step.dataset)
        step = step.after(code)
    if step.status != "complete":
        report(asdict(step))
        raise RuntimeError(f"{step.phase}/{step.dataset} failed with code {code}")
    return step


def lane(work: Callable[[str, str], int], gate: Callable[[str], None], complete: Callable[[str, str], bool], report: Callable[[dict], None] = lambda state: None) -> list[tuple[str, str, int]]:
    """Carries out all steps that aren't complete. (phase, dataset, attempts) of what ran.

    The pilot's gate is checked behind it, also if it was complete before.
    """
    ran = []
    for step in starmap(Step, product(PHASES, DATASETS)):
        if not complete(step.phase, step.dataset):
            ran.append(carried_out(step, work, report))
        if step.phase == PHASES[0]:
            gate(step.dataset)
    report({"status": "complete"})
    return [(step.phase, step.dataset, step.attempt) for step in ran]


def resume(rows: DataFrame, records: DataFrame, config: dict, before: dict | None) -> DataFrame:
    """Rows still to do; a run with another configuration is refused."""
    if before is not None and before != config:
        raise ValueError("the run was begun with another configuration")
    return unfinished(rows, records)


def frozen(found: dict[str, str], expected: dict[str, str], started: Iterable[str] = ()) -> None:
    """Fails if files differ from their manifest; a manifest is not renewed once a run has started."""
    if found != expected:
        raise ValueError("files changed after the freeze")
    if list(started):
        raise ValueError("already started")
