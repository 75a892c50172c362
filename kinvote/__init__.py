"""kinvote: labelled-text features, near neighbours and neighbour-vote classification on Spark."""

__version__ = "0.1.0"
