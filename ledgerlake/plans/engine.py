"""The engine's surface: one method for each task that works on ledgers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions.urls import canonical_url
from ..operators import dedupe, history, inventory, ledger, queueing, ranking
from ..sources import pages as pages_
from ..sources.ledgers import digest
from . import ledger_snapshot, runs
from . import snapshot as snapshot_


@dataclass(frozen=True)
class Engine:
    settings: Settings = DEFAULT

    def cards(self, pages: DataFrame) -> DataFrame:
        return pages_.scan_cards(pages, self.settings)

    def build_inventory(self, pages: DataFrame, history_: DataFrame, success: DataFrame, blocked: DataFrame, ignored: DataFrame, files: DataFrame | None = None, new_only: bool = False, credential_at: str = "") -> dict[str, DataFrame]:
        """Cards to classified items: parse, rank, merge, ledgers. Asset duplicates count as success after blocks are pruned."""
        cards = self.cards(pages)
        best = dedupe.best_cards(cards, self.settings)
        one = best.withColumns({"canonical_url": canonical_url(F.col("base_url"), F.col("key"), self.settings), "source_pages": F.array("page"), "media_url": F.lit(""), "resolved_at": F.lit("")})
        items = dedupe.merge_items(one)
        blocks = queueing.pruned_blocks(blocked, success)
        finished = history_.join(success, "key", "left_semi")
        same = dedupe.asset_duplicates(items, finished)
        done = success.select("key").union(same.select("key")).distinct()
        held = queueing.matching_blocks(items, blocks, done, credential_at, self.settings)
        free = items.join(held.select("key"), "key", "left_anti")
        return {"cards": cards, "items": items, "links": inventory.link_counts(cards), "blocked": held, "success": done, "queue": queueing.classified(free, history_, done, ignored, files, new_only)}

    def apply_outcomes(self, items: DataFrame, results: DataFrame, failures: DataFrame, blocked: DataFrame, success: DataFrame, content: DataFrame, now: str) -> dict[str, DataFrame]:
        """Outcomes into ledgers: content claims, blocks, successes, counters."""
        claims = dedupe.content_claims(results.filter("status = 'downloaded'").select("ord", "key", F.col("sha256").alias("hash")), content)
        good = results.filter(F.col("status").isin("downloaded", "skipped", "duplicate")).select("key")
        return {"claims": claims, "blocked": ledger.blocked_upsert(blocked, items, failures, now, self.settings), "success": success.select("key").union(good).distinct(), "counts": history.outcome_counts(results)}

    def repair_candidates(self, items: DataFrame, completed: DataFrame, blocked: DataFrame, retryable: DataFrame, ignored: DataFrame) -> DataFrame:
        return queueing.repair_candidates(items, completed, blocked, retryable, ignored)

    def summarise_run(self, run: runs.Run, manifest: DataFrame, failures: DataFrame, listing_failures: DataFrame) -> DataFrame:
        return runs.summarise_run(run, manifest, failures, listing_failures, self.settings)

    def retain(self, versions: DataFrame, *order) -> DataFrame:
        """The versions that stay, newest first by ``order``."""
        return ranking.retained(versions, self.settings.retained_backups, *order)

    def snapshot(self, facts: DataFrame) -> DataFrame:
        return snapshot_.snapshot(facts, self.settings)

    def snapshot_of(self, ledgers: ledger_snapshot.Ledgers, now: str) -> dict[str, DataFrame]:
        """The status snapshot at ``now`` straight from ledgers: its row (facts, alerts, stages, status) and its lists."""
        return ledger_snapshot.snapshot_of(ledgers, now, self.settings)

    def repair_event(self, run: runs.Run, attempted: DataFrame, manifest: DataFrame, failures: DataFrame, items: DataFrame, ignored: DataFrame) -> DataFrame:
        """The event of a repair from what it left behind."""
        return runs.repair_event(run, attempted, manifest, failures, items, ignored, self.settings)

    def identity(self, table: DataFrame, *without: str) -> DataFrame:
        return digest(table, *without)
