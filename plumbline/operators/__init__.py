"""DataFrame -> DataFrame steps over observations, runs and legs."""
