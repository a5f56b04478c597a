"""Reading, validating and listing inputs."""
