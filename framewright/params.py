"""Thresholds of the frame operators.  Counts of frames that stand for seconds follow the frame rate."""

from __future__ import annotations

from dataclasses import dataclass

# State codes, edge bits and their names.
GEOMETRY_SOURCES = {0: "ninguna", 1: "radial", 2: "radial_desacuerdo", 3: "contorno"}
CONTENT_STATES = {0: "usable", 1: "clipped", 2: "uncertain"}
CENTERING_STATES = {0: "reliable", 1: "reconstructed", 2: "unresolved"}
REGIMES = {0: "limbo", 1: "respaldo_transitorio", 2: "horizonte_confirmado"}
EDGE_BITS = {"left": 1, "right": 2, "top": 4, "bottom": 8}
RADIUS_TOLERANCE = 0.08
#: Versions that a stored analysis depends on (fixed values).
VERSIONS = {"version": 6, "visible_version": 2, "contrast_version": 5, "clip_version": 3, "tear_version": 1}

# The texts of reasons, as they stand in the files, and the most characters of a column of them.
REGIME_REASONS = {
    "transient": "degradación transitoria o evidencia insuficiente",
    "limbo": "limbo exterior fiable y coherente",
    "horizon": "horizonte confirmado: pérdida sostenida y monotónica del limbo",
    "false_circle": "falso círculo posterior al horizonte; rechazado como ancla",
}
REPAIR_REASONS = {
    "none": "sin reparación automática",
    "jitter": "innovación local sin respaldo del movimiento relativo",
    "excursion": "innovación acumulada incompatible con anclas y movimiento relativo",
    "jump": "salto real confirmado por movimiento relativo y medición independiente",
    "weights": "ponderación robusta de innovación",
    "off": "reparación automática desactivada (--no-auto-repair)",
}
TEAR_REASONS = {
    "none": "sin caída temporal anómala",
    "border": "no evaluado: classify_clipping confirmó recorte de borde",
    "horizon": "no evaluado: frame en régimen de horizonte confirmado",
    "not_evaluable": "no evaluado: exposición o geometría insuficiente",
    "confirmed": "pérdida temporal breve de fotosfera confirmada",
    "sustained": "vetado: anomalía sostenida de %d frames",
}
CONTENT_REASONS = {
    "tear": "pérdida temporal de fotosfera confirmada (%.1f%%)",
    "border": "recorte real en %s (acuerdo %d%%)",
    "edge": "borde",
    "usable": "contenido solar completo dentro del lienzo",
    "dark": "brillo bajo max=%d",
    "weak": "evidencia geométrica débil (%d radial)",
    "unclear": "sin evidencia suficiente para decidir",
    "corrupt": "candidato a corrupción por varias señales; revisión necesaria",
}
CENTERING_REASONS = {
    "anchor": "medición directa usada como ancla",
    "support": "reconstruido con respaldo de contraste y movimiento relativo",
    "neighbours": "reconstruido entre vecinos fiables (prev %d, next %d)",
    "conflict": "señales de movimiento contradictorias; centrado sin resolver",
    "none": "sin ancla fiable cercana; no se garantiza el centrado",
    "contradicted": "reconstrucción contradictoria: contenido incierto sin geometría fiable y señal de error de seguimiento (jitter/excursión) no confirmada",
}
SELECTION_REASONS = {
    "profile": "descartado por perfil explícito",
    "drop": "descartado manualmente con --drop-frames",
    "keep": "recuperado manualmente con --keep-frames",
}
REASON_CHARS = 90


@dataclass(frozen=True)
class Params:
    fps: float = 30.0
    scale: float = 1.0
    radius: float = 80.0
    tear_drop: float = 0.08
    tear_noise: float = 6.0
    tear_seconds: float = 0.067
    min_quality: float = 0.01
    min_coverage: float = 150.0
    min_points: int = 35
    dark_level: int = 8
    recover_run: int = 5
    closure_span: int = 60
    gate_span: int = 60
    spike_reach: int = 5

    def frames(self, seconds: float, least: int) -> int:
        """``seconds`` as frames, rounded half to even, ``least`` at the least."""
        return max(least, round(seconds * self.fps))
