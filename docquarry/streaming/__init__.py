"""docquarry.streaming"""
