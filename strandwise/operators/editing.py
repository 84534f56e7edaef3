"""Base and prime editing, paired nickases: what can be done at the guides of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise import dims
from strandwise.functions.seq import revcomp


def cut_points(guides: DataFrame, pam_cut: int, target_cut: int) -> DataFrame:
    """guides (spacer, strand, start) with cut_pam and cut_target: where either strand is cut, counted
    from the spacer's first base on its own strand, as boundaries in forward coordinates."""
    n, start = F.length("spacer"), F.col("start")
    place = lambda k: F.when(F.col("strand") == "forward", start + k).otherwise(start + n - k)
    return guides.withColumns({"cut_pam": place(F.lit(pam_cut)), "cut_target": place(F.lit(target_cut))})


def base_edits(guides: DataFrame, editors: list[tuple] | None = None) -> DataFrame:
    """Guides (20-base spacers) times editors, those with something to edit: editor, n_editable, first
    (the spacer position, from 1, of the first editable base), edited (the spacer after all of them)."""
    rows = editors or dims.BASE_EDITORS
    low, high = F.col("low"), F.col("high")
    table = guides.sparkSession.createDataFrame(rows, "editor string, base string, becomes string, low int, high int")  # the editors known
    window = F.expr("substring(spacer, low, high - low + 1)")
    both = guides.join(F.broadcast(table))
    edited = F.concat(F.expr("substring(spacer, 1, low - 1)"), F.expr("replace(substring(spacer, low, high - low + 1), base, becomes)"), F.expr("substring(spacer, high + 1)"))
    n = F.length(window) - F.length(F.replace(window, F.col("base"), F.lit("")))
    first = F.expr("locate(base, spacer, low)")
    return both.where(F.length("spacer") >= high).withColumns({"n_editable": n, "first": first, "edited": edited}).where("n_editable > 0").drop("base", "becomes", "low", "high")


def nick_pairs(guides: DataFrame, most: int = 100) -> DataFrame:
    """seq_id, forward_nick, reverse_nick, overhang, size: guides on opposite strands whose target
    strands, nicked at cut_target, lie within ``most`` bases (the short way round on a circle).

    A band join: nicks are dealt to bins of ``most`` bases and meet in their own and the neighbouring
    bins only. guides: seq_id, topology, length, strand, cut_target."""
    n, circle = F.col("length"), F.col("topology") == "circular"
    at = F.when(circle, F.pmod("cut_target", n)).otherwise(F.col("cut_target"))
    bins = F.greatest(F.ceil(n / most).cast("int"), F.lit(1))
    nick = guides.select("seq_id", "topology", "length", "strand", at.cast("int").alias("at"))
    own = nick.where("strand = 'reverse'").select("seq_id", "topology", "length", F.col("at").alias("f"), F.explode(_bins(F.col("at"), most, bins, circle)).alias("bin"))
    other = nick.where("strand = 'forward'").select("seq_id", F.col("at").alias("r"), F.least(F.floor(F.col("at") / most).cast("int"), bins - 1).alias("bin"))
    gap = F.col("r") - F.col("f")
    short = F.when(circle, F.pmod(gap + F.floor(n / 2).cast("int"), n) - F.floor(n / 2).cast("int")).otherwise(gap)
    pairs = own.join(other, ["seq_id", "bin"]).withColumn("offset", short).where(F.abs("offset") <= most)
    kind = F.when(F.col("offset") > 0, "5prime").when(F.col("offset") < 0, "3prime").otherwise("blunt")
    return pairs.select("seq_id", F.col("f").alias("forward_nick"), F.col("r").alias("reverse_nick"), kind.alias("overhang"), F.abs("offset").alias("size")).distinct()


def _bins(at: Column, most: int, bins: Column, circle: Column) -> Column:
    """The bins within ``most`` bases of a place; the last bin of a circle may be short, so the one
    before it and the second from the origin are looked at too."""
    b = F.least(F.floor(at / most).cast("int"), bins - 1)
    near = F.array(*[b + k for k in (-2, -1, 0, 1, 2)])
    return F.array_distinct(F.when(circle, F.transform(near, lambda x: F.pmod(x, bins))).otherwise(F.filter(near, lambda x: (x >= 0) & (x < bins))))


def prime_edits(guides: DataFrame, edits: DataFrame, pam: int = 3, nick: int = 17, pbs: int = 13, homology: int = 10, reach: int = 30, longest: int = 60) -> DataFrame:
    """seq_id, edit_id, strand, nick, distance, pbs, rtt, disrupts_pam: pegRNAs that install an edit
    (seq_id, edit_id, at, deleted, inserted: forward strand, on lines) from a guide whose nick lies up
    to ``reach`` bases before it on the PAM strand. guides: seq_id, sequence, strand, start, spacer.

    The extension's template is the reverse complement of the edited strand from the nick to
    ``homology`` bases past the edit, its primer binding site that of the ``pbs`` bases before."""
    size, forward = F.length("sequence"), F.col("strand") == "forward"
    rows = guides.join(edits, "seq_id").withColumn("text", F.when(forward, F.upper("sequence")).otherwise(revcomp(F.upper("sequence"))))
    spacer = F.length("spacer")
    # everything below in coordinates of the PAM strand
    own = F.when(forward, F.col("start")).otherwise(size - F.col("start") - spacer)
    first = F.when(forward, F.col("at")).otherwise(size - F.col("at") - F.col("deleted"))
    rows = rows.withColumns({"cut": own + nick, "first": first, "new": F.when(forward, F.upper("inserted")).otherwise(revcomp(F.upper("inserted"))), "pam_at": own + spacer})
    rows = rows.withColumn("distance", F.col("first") - F.col("cut")).where(F.col("distance").between(0, reach))
    past = F.greatest(F.lit(homology), F.col("pam_at") - F.col("cut") + pam)
    fits = (F.col("cut") >= pbs) & (F.col("first") + F.col("deleted") + past <= size) & (F.col("distance") + F.length("new") + homology <= longest)
    rows = rows.where(fits).withColumn("edited", F.concat(F.expr("substring(text, cut + 1, distance)"), "new", F.expr("substring(text, first + deleted + 1)")))
    rtt = F.substring("edited", F.lit(1), F.col("distance") + F.length("new") + homology)
    primer = F.substring("text", F.col("cut") - pbs + 1, F.lit(pbs))
    ahead = F.col("pam_at") - F.col("cut")
    changed = (F.col("distance") < ahead + pam) & (F.substring("edited", ahead + 1, F.lit(pam)) != F.substring("text", F.col("pam_at") + 1, F.lit(pam)))
    forward_nick = F.when(forward, F.col("cut")).otherwise(size - F.col("cut"))
    return rows.where(F.concat(primer, rtt).rlike("^[ACGT]*$")).select("seq_id", "edit_id", "strand", forward_nick.alias("nick"), "distance", revcomp(primer).alias("pbs"), revcomp(rtt).alias("rtt"), changed.alias("disrupts_pam"))
