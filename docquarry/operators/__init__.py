"""docquarry.operators"""
