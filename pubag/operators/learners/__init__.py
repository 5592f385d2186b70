"""Base learners. Each trains the models of every bag (and axis value) in one job.

Contract: ``fit_rows(rows, axes, d, first, bags, fbags=None)`` takes the training rows stored once
(``bag_sums.training_rows``) and returns (axis index, bag, model columns…) of every model, the columns as
``MODEL`` declares them; learners without it have ``fit(bagged, rows, features, axis, label, fbags=None,
first_bag=0)`` over rows that are copied per bag and return one row per (axis…, bag). ``unpack(row)`` makes arrays of one such
row and ``np_proba(m, x)`` gives p(class 1) of that model for the rows of an array (also
``np_decision``, ``np_log_proba``, ``np_terms`` where the learner has them; with ``np_map`` they get the rows
mapped once for all models of an axis value); ``model_bytes(d)``
bounds the size of one model so that slices of the model table stay bounded. ``additive``
learners take the rows of every bag once (``shared``); rows are dealt evenly before many bags with ``slow_votes``
score them.
"""

from __future__ import annotations


def registry(name: str, **params):
    if name in ("gnb", "gaussian_nb"):
        from pubag.operators.learners.gnb import GaussianNB
        return GaussianNB(**params)
    if name in ("tree", "decision_tree"):
        from pubag.operators.learners.tree import DecisionTree
        return DecisionTree(**params)
    if name == "random_forest":
        from pubag.operators.learners.tree_ensembles import Forest
        return Forest(**params)
    if name == "boosted_trees":
        from pubag.operators.learners.tree_ensembles import BoostedTrees
        return BoostedTrees(**params)
    if name == "kernel_svm":
        from pubag.operators.learners.gradient import KernelSVM
        return KernelSVM(**params)
    if name == "mlp":
        from pubag.operators.learners.gradient import Perceptron
        return Perceptron(**params)
    if name in ("mllib_random_forest", "mllib_boosted_trees", "mllib_kernel_svm", "mllib_mlp"):
        from pubag.operators.learners.mllib import MLlibLearner
        return MLlibLearner(name.removeprefix("mllib_"), **params)
    raise ValueError(f"unknown learner {name!r}")
