"""Composable search plans, their planner, ready-made tasks and cost models."""
