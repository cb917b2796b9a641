"""Search spaces.  Fixed values: results of a search are only comparable over the same spaces."""

BOTH = (True, False)

LOGISTIC_REGRESSION = {
    "regParam": (0.0, 0.001, 0.01, 0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0),
    "elasticNetParam": (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0),
    "maxIter": (10, 50, 100, 200, 500, 1000, 2000),
    "tol": (1e-6, 1e-5, 1e-4, 1e-3, 1e-2),
    "fitIntercept": BOTH,
    "standardization": BOTH,
    "threshold": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95),
    "aggregationDepth": (2, 5, 10),
}

GRADIENT_BOOSTED_TREES = {
    "maxIter": (10, 20, 50, 100, 200, 300, 500),
    "maxDepth": (2, 3, 4, 5, 7, 10),
    "stepSize": (0.01, 0.05, 0.1, 0.15, 0.2, 0.3),
    "subsamplingRate": (0.5, 0.6, 0.7, 0.8, 0.9, 1.0),
    "featureSubsetStrategy": ("auto", "onethird", "sqrt", "log2"),
    "minInstancesPerNode": (1, 2, 5, 10, 20, 30),
    "minInfoGain": (0.0, 0.01, 0.05, 0.1),
    "maxBins": (16, 32, 64, 128, 256),
}

RANDOM_FOREST = {
    "numTrees": (10, 25, 50, 100, 150, 200, 300, 500),
    "maxDepth": (3, 5, 8, 10, 15, 20, 25, 30),
    "minInstancesPerNode": (1, 2, 5, 10, 15, 20, 30, 50),
    "maxBins": (32, 64, 96, 128, 256),
    "featureSubsetStrategy": ("auto", "sqrt", "log2", "onethird"),
    "subsamplingRate": (0.6, 0.7, 0.8, 0.9, 1.0),
    "impurity": ("gini", "entropy"),
}

RANDOM_FOREST_REGRESSION = RANDOM_FOREST | {"impurity": ("variance",)}

MULTILAYER_PERCEPTRON = {
    "hidden": ((16,), (32,), (64,), (128,), (16, 8), (32, 16), (64, 32), (128, 64), (64, 32, 16), (128, 64, 32), (256, 128, 64)),
    "maxIter": (50, 100, 200, 300, 500),
    "stepSize": (0.001, 0.01, 0.03, 0.05, 0.1, 0.3),
    "tol": (1e-6, 1e-5, 1e-4, 1e-3),
    "blockSize": (64, 128, 256),
    "solver": ("l-bfgs", "gd"),
}

# The one solver Spark's generalized linear regression has is "irls".
GENERALIZED_LINEAR_REGRESSION = {
    "family": ("gaussian", "gamma", "poisson", "tweedie"),
    "maxIter": (10, 25, 50, 100, 200),
    "tol": (1e-6, 1e-5, 1e-4, 1e-3),
    "regParam": (0.0, 0.01, 0.1, 0.5, 1.0, 5.0),
    "fitIntercept": BOTH,
    "solver": ("irls",),
    "variancePower": (0.0, 1.0, 2.0),
    "linkPower": (0.0, 0.5, 1.0),
}

SUPPORT_VECTOR_MACHINE = {
    "regParam": (0.001, 0.01, 0.1, 0.5, 1.0, 5.0, 10.0, 50.0, 100.0, 500.0),
    "maxIter": (10, 50, 100, 200, 500, 1000, 2000),
    "tol": (1e-6, 1e-5, 1e-4, 1e-3, 1e-2),
    "fitIntercept": BOTH,
    "standardization": BOTH,
    "threshold": (0.0, 0.3, 0.4, 0.5, 0.6, 0.7),
    "aggregationDepth": (2, 4, 8),
}

LINEAR_REGRESSION = {
    "regParam": (0.0, 0.00001, 0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 25.0, 50.0, 100.0, 500.0, 1000.0),
    "elasticNetParam": (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0),
    "maxIter": (10, 25, 50, 100, 200, 500, 1000, 2000),
    "tol": (1e-8, 1e-7, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2),
    "fitIntercept": BOTH,
    "standardization": BOTH,
    "solver": ("auto", "normal", "l-bfgs"),
    "aggregationDepth": (2, 3, 4),
}
