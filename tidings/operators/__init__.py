"""DataFrame operators, feature stages and classifiers."""
