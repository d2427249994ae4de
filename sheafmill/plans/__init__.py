"""Settings, the engine facade, its command line and the query registry."""
