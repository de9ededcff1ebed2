"""Detectors and repairs that learn from all series at once, or by optimisation, by name: they train when they are called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from seriesmend.operators import graphs, kshape, likelihood, networks, recurrent, svm

DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "Series2Graph": graphs.series2graph, "WindowMeans": networks.window_mean_autoencoder, "KShapeAD": kshape.sand, "OCSVM": svm.one_class, "AutoEncoder": networks.autoencoder, "USAD": networks.usad,
    "LSTMAD": recurrent.lstm_detector, "CATCH": recurrent.catch, "TranAD": recurrent.tranad, "GARCH": likelihood.garch_score,
}
REPAIRS: dict[str, Callable[..., DataFrame]] = {"cae_m": networks.cae_m_repair, "lstm_sequence": recurrent.lstm_sequence_repair, "svr_tube": svm.tube_repair, "arma_ml": likelihood.arma_ml}
