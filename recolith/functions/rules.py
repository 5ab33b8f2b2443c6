"""Classifiers and decision ladders (PF03-PF08, PF10, PF15, PF16, PF20, PF22, PF25, PF26, PF28, PF42, ST08)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recolith.functions import text as tx


def ladder(*steps: tuple[Column, str], default: str) -> Column:
    """The label of the first condition that holds; the order is the meaning."""
    return reduce(lambda c, s: c.when(s[0], F.lit(s[1])), steps[1:], F.when(steps[0][0], F.lit(steps[0][1]))).otherwise(default)


def reasons(**checks: Column) -> Column:
    """PF20, PF26: the names of all checks that hold, in order; empty if none does."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))


# Codec ranks of the duplicate audit (all others rank 1) and scores of extensions.
CODEC_RANK = {"flac": 5, "alac": 5, "pcm_s16le": 5, "pcm_s24le": 5, "pcm_s32le": 5, "pcm_f32le": 5, "wavpack": 5, "ape": 4}
EXTENSION_SCORE = {".flac": 60, ".alac": 55, ".m4a": 45, ".aif": 40, ".aiff": 40, ".wav": 35, ".mp3": 30, ".opus": 25, ".ogg": 20}


def quality_tier(lossless: Column, lossy: Column, rate: Column, bits: Column, bitrate: Column, ext: Column) -> Column:
    """PF04 and C1: tier, capped and fallback scores, extension score."""
    r, b, br = (F.coalesce(c, F.lit(0)).cast("long") for c in (rate, bits, bitrate))
    above = lossless & ((r > 44100) | (b > 16))
    cd = lossless & (r == 44100) & (b == 16)
    tier = ladder((cd, "cd_lossless"), (lossless & ~above, "lossless_not_above_cd"), (lossy, "lossy_below_cd"), (above, "master_above_cd"), default="unknown")
    capped = F.when(cd, F.lit(1000)).when(lossless & ~above, 900 + F.least(b, F.lit(16))).when(lossy, 600 + F.least(F.floor(br / 1000), F.lit(320))).when(above, F.lit(-1000)).otherwise(0).cast("long")
    fallback = F.when(above, 500000 - (F.greatest(F.lit(0), r - 44100) + F.greatest(F.lit(0), b - 16) * 10000)).otherwise(capped)
    score = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSION_SCORE.items() for x in kv]), ext), F.lit(0))
    return F.struct(tier.alias("tier"), capped.alias("capped"), fallback.alias("fallback"), score.alias("ext_score"), F.coalesce(above, F.lit(False)).alias("above_cd"))


def packed_score(lossless: Column, rate: Column, bits: Column, bitrate: Column) -> Column:
    """PF05 and C3."""
    r, b, br = (F.coalesce(c, F.lit(0)).cast("long") for c in (rate, bits, bitrate))
    above = (r > 44100) | (b > 16)
    category = F.when(lossless & (r == 44100) & (b == 16), 400).when(~lossless, 300).when(lossless & ~above & (r > 0), 250).when(lossless & above, 200).otherwise(100)
    return category.cast("long") * 1000000000 + r * 10000 + b * 100000 + br


def rank_score(lossless_rank: Column, rate: Column, bits: Column, bitrate: Column, size: Column) -> Column:
    """PF06 and C4; an unknown codec ranks 1."""
    d = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return F.coalesce(lossless_rank, F.lit(1)).cast("double") * 1e6 + d(rate) * 10 + d(bits) * 1e3 + d(bitrate) / 1e3 + d(size) / 1e9


def high_res(lossless: Column, rate: Column, bits: Column) -> Column:
    """PF07."""
    return F.coalesce(lossless & ((rate > 44100) | (bits > 16)), F.lit(False))


def cd_quality(codec: Column, rate: Column, bits: Column) -> Column:
    """PF08."""
    return F.coalesce((rate == 44100) & (bits == 16) & codec.isin("flac", "alac", "pcm_s16le", "pcm_s16be"), F.lit(False))


# Advice sentences.
ADVICE_SAME = "Conserver le meilleur candidat qualite, fusionner les metadonnees/playlists, puis supprimer ou mettre en quarantaine les doublons seulement apres validation."
ADVICE_CLOSE = "Verifier l'audio ou Chromaprint avant suppression; si c'est le meme morceau, garder le meilleur candidat qualite."
ADVICE_OTHER = "Ne pas supprimer automatiquement; si l'audio ou l'arrangement est different, renommer le titre avec une variante explicite, par exemple '(alt)' ou le nom du mix."


def group_advice(kind: Column) -> Column:
    """PF10."""
    return F.when(kind.isin("exact_file_duplicate", "decoded_audio_duplicate"), ADVICE_SAME).when(kind == "same_name_same_duration_candidate", ADVICE_CLOSE).otherwise(ADVICE_OTHER)


def titles_match(left: Column, right: Column, mode: str) -> Column:
    """PF03."""
    if mode == "none":
        return F.lit(True)
    key = (lambda c: tx.loose_title_key(c, master=False)) if mode == "loose" else tx.safe_title_key
    return key(left) == key(right)


def pick_genre(primary: Column, secondary: Column) -> Column:
    """PF16: the first that is not ``manual_review``."""
    options = F.concat(F.array(tx.spaced(F.coalesce(primary, F.lit("")))), tx.genre_list(secondary, "[;,/]"))
    good = F.filter(options, lambda x: (x != "") & (F.lower(x) != "manual_review"))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


# The statuses, actions and reasons in the ladders from here on.


def recommendation_status(content_id: Column, found: Column, path: Column, genre: Column, review: Column, conf: Column, current: Column, cutoff: str = "medium", include_review: bool = False, include_streaming: bool = False, exclude_tools: bool = True, overwrite: bool = False) -> Column:
    """PF15: one status a row; earlier steps win."""
    rank = {"low": 1, "medium": 2, "high": 3}[cutoff]
    key = lambda c: F.lower(tx.spaced(F.coalesce(c, F.lit(""))))
    return ladder(
        (F.coalesce(content_id, F.lit("")) == "", "skipped_invalid_content_id"),
        (~F.coalesce(found, F.lit(False)), "not_found_in_db"),
        (tx.is_streaming(path) & F.lit(not include_streaming), "skipped_streaming"),
        (tx.as_bool(review) & F.lit(not include_review), "skipped_review_required"),
        (tx.confidence_rank(conf) < rank, "skipped_low_confidence"),
        (key(genre) == "", "skipped_no_genre_candidate"),
        ((key(genre) == "tools samples") & F.lit(exclude_tools), "skipped_genre_filter"),
        ((key(genre) == key(current)) & F.lit(not overwrite), "unchanged"),
        default="would_update",
    )


def duplicate_reasons(dup: Column, keep: Column, dup_exists: Column, keep_exists: Column, similarity: Column, titles: Column, d_dup: Column, d_keep: Column, least: float = 0.98, tolerance: float = 1.0) -> Column:
    """PF20: all guards that fail; empty means the row may be planned."""
    diff = F.abs(d_dup - d_keep)
    return reasons(same_path=dup == keep, duplicate_path_missing=~dup_exists, keep_path_missing=~keep_exists, below_similarity_threshold=F.coalesce(similarity, F.lit(0.0)) < least, title_key_mismatch=~titles, duration_mismatch=diff > tolerance, duration_unavailable=diff.isNull())


def exact_blocker(dup_found: Column, keep_found: Column, dup_sha: Column, keep_sha: Column, expected: Column) -> Column:
    """PF22."""
    return ladder((~dup_found, "blocked_duplicate_missing"), (~keep_found, "blocked_keep_missing"), (F.upper(dup_sha) != F.upper(expected), "blocked_duplicate_hash_changed"), (F.upper(keep_sha) != F.upper(dup_sha), "blocked_hash_mismatch"), default="planned")


def missing_action(target: Column, target_rows: Column, refs: Column) -> Column:
    """PF25."""
    return ladder((target.isNotNull() & (target_rows > 0), "auto_relink_merge"), (target.isNotNull(), "auto_relink_only"), (refs == 0, "auto_delete_unreferenced_missing"), default="review")


def proposal(has_candidate: Column, label: Column, existing: Column, no_ok: Column, artists: Column) -> Column:
    """PF42: decision state, confidence and reasons."""
    weak = label.isin("low", "identity_only")
    conf = F.when(has_candidate, label).when(existing, "medium").otherwise("none")
    first = F.when(has_candidate & weak, "low confidence candidate").when(has_candidate, F.lit(None)).when(existing, "existing genre tag found but no external confirmation").otherwise("no genre candidate")
    unsure = ~conf.isin("high", "medium")
    demote = unsure & (no_ok | (artists > 2))
    state = F.when(demote | (has_candidate & weak) | (~has_candidate & ~existing), "manual_review").when(has_candidate, "proposed").otherwise("existing_tag_only")
    why = F.concat_ws("; ", first, F.when(unsure & no_ok, F.lit("no platform ok")), F.when(unsure & (artists > 2), F.lit("multiple artists")))
    return F.struct(state.alias("decision_state"), conf.alias("confidence_label"), why.alias("review_reason"))


def operation_violations(op: Column, src: Column, dst: Column, exts: list[str], src_root: Column, dst_root: Column, src_exists: Column, dst_exists: Column) -> Column:
    """PF26: rules that an operation breaks; ``op`` has its types and file status, existence comes from an inventory."""
    from recolith.functions.paths import compare_key, extension

    return reasons(
        unsupported_type=~op["op_type"].isin("move_file", "rename_file", "file_move", "file_rename"),
        target_is_not_a_file=op["target_kind"] != "file",
        not_pending=~op["file_action_status"].isin("pending", "blocked"),
        same_path=compare_key(src) == compare_key(dst),
        source_extension=~extension(src).isin(*exts),
        destination_extension=~extension(dst).isin(*exts),
        extension_changes=extension(src) != extension(dst),
        source_outside_roots=src_root.isNull(),
        destination_outside_roots=dst_root.isNull(),
        source_missing=~src_exists,
        destination_exists=dst_exists,
    )


def retry_decision(locked: Column, active: Column, remaining: Column, ready_at: Column, now: Column, dry_run: Column) -> Column:
    """ST08."""
    return ladder((locked, "skipped_locked"), (active, "skipped_active_run"), (remaining == 0, "done"), (ready_at.isNotNull() & (ready_at > now), "cooldown"), (dry_run, "dry_run"), default="start")


# Event lengths by code index, status names and control names.
CIN_LENGTHS = {2: 2, 3: 3, 4: 3, 5: 1, 6: 2, 7: 3, 8: 3, 9: 3, 10: 3, 11: 3, 12: 2, 13: 2, 14: 3, 15: 1}
STATUS_NAMES = {0x80: "note_off", 0x90: "note_on", 0xA0: "poly_pressure", 0xB0: "control_change", 0xC0: "program_change", 0xD0: "channel_pressure", 0xE0: "pitch_bend"}
NOTE_NAMES = {11: "PLAY/PAUSE", 12: "CUE", 62: "TIME/AUTO CUE", 63: "TIME/AUTO CUE + SHIFT", 66: "Rotary selector press", 67: "Rotary selector press + SHIFT", 68: "BACK", 69: "BACK + SHIFT", 71: "PLAY/PAUSE + SHIFT", 72: "CUE + SHIFT"}
CC_NAMES = {1: "Jog dial outer", 2: "Jog dial top", 4: "TEMPO slider", 16: "AUTO BEAT LOOP control", 64: "Rotary selector turn", 65: "Rotary selector turn + SHIFT"}
MIXER_NAMES = {3: "TRIM channel A", 4: "TRIM channel B", 7: "EQ HI channel A", 8: "EQ HI channel B", 11: "EQ MID channel A", 12: "EQ MID channel B", 15: "EQ LOW channel A", 16: "EQ LOW channel B", 19: "Channel fader A", 20: "Channel fader B", 23: "Crossfader", 24: "Master level", 35: "TRIM channel C", 36: "TRIM channel D", 39: "EQ HI channel C", 40: "EQ HI channel D", 43: "EQ MID channel C", 44: "EQ MID channel D", 47: "EQ LOW channel C", 48: "EQ LOW channel D", 51: "Channel fader C", 52: "Channel fader D"}


def _lookup(table: dict[int, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def midi(status: Column, data1: Column, data2: Column) -> Column:
    """PF28: status, channel, group, control and action of a MIDI message."""
    kind = status.bitwiseAND(0xF0)
    channel = F.when(status.between(0x80, 0xEF), status.bitwiseAND(0x0F) + 1)
    deck, note, cc = channel <= 4, kind.isin(0x80, 0x90) & data1.isNotNull(), (kind == 0xB0) & data1.isNotNull()
    group = F.when(deck, F.concat(F.lit("Deck "), F.char(channel + 64))).when(channel == 7, "Mixer").when(channel.isin(5, 6), "Effects")
    name = F.when(deck & note, _lookup(NOTE_NAMES, data1)).when(deck & cc, _lookup(CC_NAMES, data1)).when((channel == 7) & cc, _lookup(MIXER_NAMES, data1))
    action = F.when(deck & note, F.when((kind == 0x80) | F.coalesce(data2 == 0, F.lit(False)), "release").otherwise("press")).when((deck | (channel == 7)) & cc, "value").when(channel.isin(5, 6) & (kind == 0xB0), "value")
    return F.struct(F.coalesce(_lookup(STATUS_NAMES, kind), F.lit("system_or_unknown")).alias("status_name"), channel.alias("channel"), group.alias("control_group"), name.alias("control_name"), action.alias("action"))
