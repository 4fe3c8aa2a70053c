"""DataFrame-to-DataFrame operators shared by the feature, model and report plans."""
