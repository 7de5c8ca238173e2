"""Descriptors of six public datasets."""

from __future__ import annotations

from .spec import DatasetSpec

# The files' columns, in order, and their kinds.
_REGRESSION = ("mse", "mae", "r2", "pearson")
_MACHINE = ("MYCT", "MMIN", "MMAX", "CACH", "CHMIN", "CHMAX")
_FIRES = ("FFMC", "DMC", "DC", "ISI", "temp", "RH", "wind", "rain")
_SHELL = ("length", "diameter", "height", "whole weight", "shucked weight", "viscera weight", "shell weight")
_VOTES = ("handicapped infants", "water project cost sharing", "adoption of the budget resolution", "physician fee freeze", "El Salvador aid", "religious groups in schools", "anti-satellite test ban", "aid to Nicaraguan contras",
          "MX missile", "immigration", "synfuels corporation cutback", "education spending", "superfund right to sue", "crime", "duty-free exports", "export administration act South Africa")
_CELLS = ("clump thickness", "cell size uniformity", "cell shape uniformity", "marginal adhesion", "single epithelial cell size", "bare nuclei", "bland chromatin", "normal nucleoli", "mitoses")
_PRICE, _CAR = ("low", "med", "high", "vhigh"), ("buying price", "maintenance price", "doors", "persons", "luggage boot size", "safety")


def default_datasets(root: str = "../Datasets") -> dict[str, DatasetSpec]:
    """The specs by name; files are looked for under ``root``."""
    specs = [
        DatasetSpec("Computer Hardware", "regression", f"{root}/Regression/Computer Hardware/machine.data", ("vendor name", "model name", *_MACHINE, "output", "ERP"), ignore_cols=("ERP",), nominal_cols=("vendor name", "model name"), standardize_cols=_MACHINE, metrics=_REGRESSION),
        DatasetSpec("Forest Fires", "regression", f"{root}/Regression/Forest Fires/forestfires.csv", ("X", "Y", "month", "day", *_FIRES, "output"), header=0, nominal_cols=("month", "day"), standardize_cols=("X", "Y", *_FIRES), metrics=_REGRESSION),
        DatasetSpec("Abalone", "regression", f"{root}/Regression/Abalone/abalone.data", ("sex", *_SHELL, "output"), nominal_cols=("sex",), standardize_cols=_SHELL, metrics=_REGRESSION),
        DatasetSpec("Congressional Votes", "classification", f"{root}/Classification/Congressional Vote/house-votes-84.data", ("class", *_VOTES), nominal_cols=_VOTES, metrics=("acc",)),
        DatasetSpec("Car Evaluation", "classification", f"{root}/Classification/Car Evaluation/car.data", (*_CAR, "class"), metrics=("acc",),
                    ordinal_cols=dict(zip(_CAR, (_PRICE, _PRICE, (2, 3, 4, "5more"), (2, 4, "more"), ("small", "med", "big"), ("low", "med", "high")), strict=True))),
        DatasetSpec("Breast Cancer", "classification", f"{root}/Classification/Breast Cancer/breast-cancer-wisconsin.data", ("sample code number", *_CELLS, "class"), ignore_cols=("sample code number",), missing_value_symbol="?", positive_class="4", negative_class="2", metrics=("acc", "precision", "recall", "f1")),
    ]
    return {s.name: s for s in specs}
